"""The review chain with what is done to it, and a stream of frames that is stopped and goes on."""

import json
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from crosswind import review
from crosswind.streaming import feed

BOARD = "candidate string, utility double, eligible boolean"


def started(spark, tmp_path):
    folder = tmp_path / "run"
    (folder / "artifacts" / "deep").mkdir(parents=True)
    (folder / "artifacts" / "weights.csv").write_text("a,0.5\n")
    (folder / "artifacts" / "deep" / "board.csv").write_text("x\n")
    board = spark.createDataFrame([("a", 1.5, True), ("b", 2.5, True), ("c", 9.0, False), ("d", None, True)], BOARD)
    one = review.Review(spark, f"file://{folder}")
    one.vouch()
    one.decide(board, "b", "reviewer", "best")
    return folder, board, one


def test_activation_is_once(spark, tmp_path):
    folder, board, one = started(spark, tmp_path)
    assert one.faults().count() == 0 and one.activate(board, "b") and not one.activate(board.orderBy("utility"), "b") and one.faults().count() == 0
    one.decide(board, "a", "other")
    with pytest.raises(RuntimeError, match="another candidate"):
        one.activate(board, "a")
    with pytest.raises(RuntimeError, match="newest decision"):
        one.activate(board, "b")
    with pytest.raises(RuntimeError, match="newest decision"):
        one.activate(board.where("candidate <> 'd'"), "a")
    for bad in ("c", "none"):
        with pytest.raises(ValueError):
            one.decide(board, bad, "other")
    assert [r.kind for r in one.records().orderBy("seq").collect()] == ["artifacts", "decision", "activation", "decision"]
    one.record("activation", {"board": review.board_hash(board), "candidate": "a"})
    assert [tuple(r)[:2] for r in one.faults().collect()] == [(4, "second activation")]


def test_what_is_changed_is_found(spark, tmp_path):
    folder, board, one = started(spark, tmp_path)
    one.record("note", {"x": 1})
    one.record("note", {"x": 2})
    path = folder / "artifacts" / "weights.csv"
    path.write_text("a,0.6\n")
    assert [tuple(r) for r in one.faults().collect()] == [(0, "file changed", "weights.csv")]
    with pytest.raises(RuntimeError, match="file changed"):
        one.activate(board, "b")
    path.unlink()
    assert [tuple(r) for r in one.faults().collect()] == [(0, "file missing", "weights.csv")]
    path.write_text("a,0.5\n")
    assert one.faults().count() == 0
    chain = folder / "chain"
    third = chain / f"{2:012d}.json"
    whole = third.read_text()
    third.write_text(whole.replace('\\"x\\": 1', '\\"x\\": 7'))
    assert [tuple(r)[:2] for r in one.faults().collect()] == [(2, "altered")]
    forged = json.loads(third.read_text())
    forged["digest"] = review.digest_of(2, forged["kind"], forged["payload"], forged["prev"])
    third.write_text(json.dumps(forged))
    assert [tuple(r)[:2] for r in one.faults().collect()] == [(3, "unlinked")]
    third.unlink()
    assert one.faults().first()[:2] == (3, "skipped")


def test_writers_at_once_make_one_chain(spark, tmp_path):
    one = review.Review(spark, f"file://{tmp_path}/run")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: review.Review(spark, one.folder).record("note", {"k": k}), range(6)))
    assert one.records().count() == 6 and one.faults().count() == 0
    assert review.Review(spark, f"file://{tmp_path}/none").faults().count() == 0


FIELDS = {"Quote": ["symbol", "bid", "ask"], "Trade": ["symbol", "price"]}


def put(folder: Path, name: str, *lines: str) -> None:
    draft = folder / f".{name}"
    draft.write_text("\n".join(lines))
    draft.rename(folder / name)


def test_frames_go_on_from_the_checkpoint(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "0001", '["Quote", ["A", 1, 2, "B", 3, null, "Z"]]', "no frame", '["Other", ["A", 1]]', '["Trade", ["C", 5]]')
    put(folder, "0002", '["Trade", ["A", 6, "D", 7]]')

    def run(idle, hard=120.0):
        stream = feed.frames(spark, f"file://{folder}", FIELDS, ["A", "B", "C"], chunk=2)
        return feed.until_quiet(stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="200 milliseconds"), idle, hard)

    assert run(6.0) == ("idle", 4)
    put(folder, "0003", '["Trade", ["B", 8]]', '["Quote", ["A", 9, 9]]')
    assert run(6.0) == ("idle", 2) and run(4.0) == ("idle", 0)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.file, r.line, r.place, r.symbol, r.type) for r in got) == [
        ("0001", 0, 0, "A", "Quote"), ("0001", 0, 1, "B", "Quote"), ("0001", 3, 0, "C", "Trade"), ("0002", 0, 0, "A", "Trade"), ("0003", 0, 0, "B", "Trade"), ("0003", 1, 0, "A", "Quote"),
    ]
    assert next(r.event for r in got if r.file == "0001" and r.symbol == "B") == {"symbol": "B", "bid": "3", "ask": None}
    assert run(60.0, hard=2.0)[0] == "hard"


def test_frames_without_symbols_and_files(spark, tmp_path):
    reader = feed.FrameReader({"path": f"file://{tmp_path}/nothing", "fields": json.dumps(FIELDS)})
    assert reader.latestOffset() == reader.initialOffset() == {"files": 0} and [c.symbols for c in reader.partitions({"files": 0}, {"files": 0})] == [[]]
    put(tmp_path, "a", '["Trade", ["X", 1.5]]', '["Trade", 3]', "[1, 2, 3]")
    whole = feed.FrameReader({"path": f"file://{tmp_path}", "fields": json.dumps(FIELDS)})
    assert [r[:3] for p in whole.partitions({"files": 0}, whole.latestOffset()) for r in whole.read(p)] == [("X", "Trade", {"symbol": "X", "price": "1.5"})]
