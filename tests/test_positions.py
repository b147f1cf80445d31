import pytest
from pyspark.sql import functions as F

from plyforge.functions.moves import Position, legal_moves, play
from plyforge.operators import positions

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"


def count(position, depth):
    moves = position.moves()
    return len(moves) if depth == 1 else sum(count(p, depth - 1) for p in moves.values())


@pytest.mark.parametrize(
    ("fen", "counts"),  # known node counts of published test positions
    [
        (START, [20, 400, 8902]),
        ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", [48, 2039]),
        ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", [14, 191, 2812]),
        ("r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", [6, 264, 9467]),
        ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", [44, 1486]),
    ],
)
def test_node_counts(fen, counts):
    assert [count(Position.parse(fen), d + 1) for d in range(len(counts))] == counts


@pytest.mark.parametrize(
    ("fen", "move", "want"),
    [
        (START, "e2e4", "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1"),
        ("4k3/8/8/8/4p3/8/3P4/4K3 w - - 3 9", "d2d4", "4k3/8/8/8/3Pp3/8/8/4K3 b - d3 0 9"),
        ("4k3/8/8/8/3Pp3/8/8/4K3 b - d3 0 9", "e4d3", "4k3/8/8/8/8/3p4/8/4K3 w - - 0 10"),
        ("r3k2r/8/8/8/8/8/8/R3K2R w KQkq - 1 2", "e1c1", "r3k2r/8/8/8/8/8/8/2KR3R b kq - 2 2"),
        ("r3k2r/8/8/8/8/8/8/R3K2R w KQkq - 1 2", "a1a8", "R3k2r/8/8/8/8/8/8/4K2R b Kk - 0 2"),
        ("8/P6k/8/8/8/8/8/K7 w - - 0 1", "a7a8n", "N7/7k/8/8/8/8/8/K7 b - - 0 1"),
        (START, "e2e5", None),
        ("nonsense", "e2e4", None),
        (None, None, None),
    ],
)
def test_play(spark, fen, move, want):
    rows = spark.createDataFrame([(fen, move)], "fen string, move string")
    assert rows.select(play("fen", "move").alias("p")).first()["p"] == want


def test_malformed_positions_have_no_moves(spark):
    rows = spark.createDataFrame([(None,), ("",), ("8/8/8/8/8/8/8/8 w - - 0 1",), ("x w - - 0 1",)], "fen string")
    assert [r["m"] for r in rows.select(legal_moves("fen").alias("m")).collect()] == [None] * 4


def data(spark):
    legal = list(Position.parse(START).moves())
    rows = [(START, m, 0.5 + i / 100) for i, m in enumerate(legal) if m != "a2a3"] + [(START, "e2e4", 0.1), (START, "e2e5", 0.2), (START, legal[-1], 0.2), ("bad", "e2e4", 0.5), (None, "e2e4", 0.5), (START, None, 0.9)]
    return spark.createDataFrame(rows, "fen string, move string, win_prob double"), legal


def test_records(spark):
    rows, legal = data(spark)
    out = {r["fen"]: r for r in positions.records(rows).collect()}
    assert set(out) == {START, "bad"}
    r = out[START]
    assert not r["is_complete"] and r["missing"] == ["a2a3"] and r["extra"] == ["e2e5"] and r["num_moves"] == 20
    assert r["best_action"] == legal[-1] and [m["move"] for m in r["top5"]] == legal[:-6:-1] and r["next_fen"] == play_of(START, legal[-1])
    assert r["engine_rank"] is None and not r["engine_agrees"] and not r["needs_tiebreak"] and not r["is_losing"]
    assert out["bad"]["next_fen"] == "" and out["bad"]["extra"] == ["e2e4"] and out["bad"]["missing"] is None


def play_of(fen, move):
    return Position.parse(fen).moves()[move].fen()


def test_engine_and_its_failure(spark):
    rows, legal = data(spark)

    def engine():
        return lambda fen: {START: legal[-2]}[fen], lambda: None  # raises for other positions

    out = {r["fen"]: r for r in positions.records(rows, engine=engine).collect()}
    assert out[START]["best_action"] == legal[-2] and out[START]["engine_rank"] == 2 and not out[START]["engine_agrees"]
    assert out["bad"]["best_action"] == "e2e4" and out["bad"]["engine_rank"] is None


def test_no_rows(spark):
    assert positions.records(spark.createDataFrame([], "fen string, move string, win_prob double")).count() == 0
