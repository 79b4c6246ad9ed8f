"""Review and activation of a choice: records chained by digests, files that records vouch for, and one activation a board.

A record names the digest of the one before it, so that one changed, left out or put between breaks the chain from there on.
Files are vouched for by the digests of their content, which a scan of the folder computes in tasks.  ``faults`` is one query over
records and files.  A record's number and a board's activation are files that only one writer can create.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosswind.ledger import content, put_if_absent

RECORD = "seq long, kind string, payload string, prev string, digest string"


def digest_of(seq: int, kind: str, payload: str, prev: str) -> str:
    return hashlib.sha256(f"{seq}\n{kind}\n{payload}\n{prev}".encode()).hexdigest()


def board_hash(board: DataFrame) -> str:
    """24 digits that name a board's rows, whatever their order; boards have a row for each candidate."""
    rows = board.select(F.to_json(F.struct(*sorted(board.columns)), {"ignoreNullFields": "false"}).alias("r"))
    return rows.agg(F.substr(F.sha2(F.array_join(F.sort_array(F.collect_list("r")), "\n"), 256), F.lit(1), F.lit(24))).first()[0]


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, digest) of all files under a folder, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").split("://", 1)[-1].split(":", 1)[-1]
    at = F.instr("path", root) + len(root) + 1
    return files.select(F.substr("path", at).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


class Review:
    """The chain and the activations of one folder; artifacts are files under ``artifacts``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def records(self) -> DataFrame:
        try:
            return self.spark.read.schema(RECORD).json(f"{self.folder}/chain")
        except Exception as e:  # nothing is recorded yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], RECORD)

    def record(self, kind: str, payload: dict) -> str:
        """Appends a record and gives its digest; of two writers at once the later goes on from the other's record."""
        body = json.dumps(payload, sort_keys=True)
        while True:
            last = self.records().orderBy(F.desc("seq")).first()
            seq, prev = (last["seq"] + 1, last["digest"]) if last else (0, "")
            own = digest_of(seq, kind, body, prev)
            line = json.dumps({"seq": seq, "kind": kind, "payload": body, "prev": prev, "digest": own})
            if put_if_absent(self.spark, f"{self.folder}/chain/{seq:012d}.json", line):
                return own

    def vouch(self) -> str:
        """Records the digests of all artifacts as they are; artifacts of a run are few."""
        return self.record("artifacts", {r["path"]: r["digest"] for r in file_digests(self.spark, f"{self.folder}/artifacts").collect()})

    def decide(self, board: DataFrame, candidate: str, by: str, reason: str = "") -> str:
        """Records a decision on a board; the candidate has to be there and eligible."""
        found = board.where(F.col("candidate") == candidate).select("eligible").first()
        if found is None or not found["eligible"]:
            raise ValueError(f"{candidate} is not eligible on this board")
        return self.record("decision", {"board": board_hash(board), "candidate": candidate, "by": by, "reason": reason})

    def faults(self) -> DataFrame:
        """(seq, fault, what): every break of the chain, the first one first."""
        order = Window.orderBy("seq")  # records of one folder are few
        r = self.records().withColumns({"_seq": F.lag("seq", 1, -1).over(order), "_digest": F.lag("digest", 1, "").over(order)})
        own = F.sha2(F.concat_ws("\n", F.col("seq").cast("string"), "kind", "payload", "prev"), 256)
        chain = r.select("seq", F.when(F.col("seq") != F.col("_seq") + 1, "skipped").when(F.col("prev") != F.col("_digest"), "unlinked").when(F.col("digest") != own, "altered").alias("fault"), F.col("kind").alias("what")).where("fault is not null")
        claimed = self.records().where("kind = 'artifacts'").select("seq", F.explode(F.from_json("payload", "map<string, string>")).alias("path", "said"))
        newest = claimed.withColumn("_last", F.max("seq").over(Window.partitionBy("path"))).where(F.col("seq") == F.col("_last"))
        try:
            files = file_digests(self.spark, f"{self.folder}/artifacts")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            files = self.spark.createDataFrame([], "path string, size long, digest string")
        changed = newest.join(files, "path", "left").select("seq", F.when(F.col("digest").isNull(), "file missing").when(F.col("digest") != F.col("said"), "file changed").alias("fault"), F.col("path").alias("what")).where("fault is not null")
        acts = self.records().where("kind = 'activation'").select("seq", F.get_json_object("payload", "$.board").alias("board"))
        again = acts.withColumn("k", F.row_number().over(Window.partitionBy("board").orderBy("seq"))).where("k > 1").select("seq", F.lit("second activation").alias("fault"), F.col("board").alias("what"))
        return chain.unionByName(changed).unionByName(again).orderBy("seq", "fault", "what")

    def activate(self, board: DataFrame, candidate: str) -> bool:
        """True for the one activation of a board; False where this candidate is active on it already.

        The newest decision has to be this candidate's on this very board, and nothing may be wrong with the chain or its files.
        """
        broken = self.faults().first()
        if broken:
            raise RuntimeError(f"record {broken['seq']}: {broken['fault']} ({broken['what']})")
        name = board_hash(board)
        last = self.records().where("kind = 'decision'").orderBy(F.desc("seq")).first()
        said = json.loads(last["payload"]) if last else {}
        if (said.get("board"), said.get("candidate")) != (name, candidate):
            raise RuntimeError("the newest decision is not this candidate's on this board")
        path = f"{self.folder}/activations/{name}"
        if put_if_absent(self.spark, path, candidate):
            self.record("activation", {"board": name, "candidate": candidate, "decision": last["digest"]})
            return True
        if content(self.spark, path) != candidate:
            raise RuntimeError(f"another candidate is active on board {name}")
        return False
