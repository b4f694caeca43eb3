"""Token totals by source, language and tokenizer version, kept up to date by deltas.

A batch holds changes of documents: insert, delete, or a revised count. Each is
set against what earlier batches say of the document and becomes signed deltas:
minus the old count where it stood, plus the new one where it stands. The deltas
of a batch are additive, so they are summed before they are stored, and totals
are sums over batches; a source with a third of all rows is a few partial sums.

Every attempt at a batch writes folders of its own, and counts once its commit
exists: a small file named by the next number alone, put in place by a rename
that fails where the number is taken. So of two writers at once one gets the
number; the other finds it taken, sets its changes against the new state and
tries the next one. A batch that has a commit is passed over, so a batch may be
repeated after any failure; no commit names what a lost attempt left, or what a
late one still writes.

After every ``compact_every`` batches a snapshot holds the state of each
document and the totals up to its number, put in place the same way. Later
batches read the last snapshot and the batches after it, so their work does not
grow with the history.

Defined results: an insert of a known document, and a revision of one unknown,
set its count; a delete of an unknown one changes nothing; of several changes of
one document and version in a batch a delete holds, else the largest count; NULL
sources and languages are groups of their own; NULL counts are 0; a NULL id is
one document; an empty batch commits and changes nothing; a NULL or empty text
has no tokens; totals that fall to no documents are not shown.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaindex.llm.common import col, map_rows
from areaindex.llm.tokens import word_pieces

INSERT, REVISE, DELETE = "insert", "revise", "delete"
GROUPS = ("source", "lang", "version")


def count_tokens(
    docs: DataFrame, tokenizers: Mapping[str, str | None], key: str = "doc_id", text: str = "text",
    source: str = "source", lang: str = "lang",
) -> DataFrame:
    """(doc, source, lang, version, n_tokens): counts of every text under each tokenizer.

    A version without a vocabulary file counts words between white space.
    """
    kind = docs.select(col(key)).schema[0].dataType.simpleString()
    versions = dict(tokenizers)

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        encoders = {v: word_pieces(path) if path else None for v, path in versions.items()}
        for k, s, g, t in items:
            for version, encoder in encoders.items():
                n = len(encoder.encode(t)) // 4 if encoder else len((t or "").encode("utf-8", "surrogatepass").split())
                yield k, s, g, version, n

    return map_rows(
        docs.select(col(key), *[col(c).cast("string") for c in (source, lang, text)]),
        f"doc {kind}, source string, lang string, version string, n_tokens long", rows,
    )


class TokenRollup:
    """Totals stored below a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, key_type: str = "bigint", compact_every: int = 16):
        self.spark, self.folder, self.compact_every = spark, folder.rstrip("/"), compact_every
        self.state_schema = f"doc {key_type}, version string, source string, lang string, n_tokens bigint, live boolean, seq bigint"
        self.delta_schema = "source string, lang string, version string, d_docs bigint, d_tokens bigint"
        self._known: dict[tuple[str, str], dict] = {}  # what markers say never changes

    # --- commits ---------------------------------------------------------------

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return store, store.makeQualified(path)

    def _markers(self, kind: str) -> list[tuple[int, dict]]:
        """(number, content) of the markers of a kind, in order."""
        store, folder = self._path(kind)
        if not store.exists(folder):
            return []
        java, found = self.spark._jvm.java.io, []
        for name in sorted(f.getPath().getName() for f in store.listStatus(folder)):
            if not name.isdigit():
                continue
            if (kind, name) not in self._known:
                reader = java.BufferedReader(java.InputStreamReader(store.open(self._path(kind, name)[1]), "UTF-8"))
                self._known[kind, name] = json.loads(reader.readLine())
                reader.close()
            found.append((int(name), self._known[kind, name]))
        return found

    def _mark(self, kind: str, number: int, content: Mapping[str, str]) -> bool:
        """Put a marker in place, whole and at once; False if the number is taken."""
        store, draft = self._path("drafts", uuid.uuid4().hex)
        out = store.create(draft, True)
        out.write(json.dumps(content).encode())
        out.close()
        _, marker = self._path(kind, f"{number:09d}")
        store.mkdirs(marker.getParent())
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        never_replace = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, marker, never_replace)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            store.delete(draft, False)
            return False
        return True

    def committed(self) -> list[str]:
        """Batches that count, as number and name, in the order of their commits."""
        return [f"{number:09d}-{said['batch']}" for number, said in self._markers("commits")]

    def _read(self, kind: str, schema: str, upto: int | None = None) -> DataFrame:
        """Rows of the last snapshot and of the batches after it."""
        snapshots = [s for s in self._markers("snapshots") if upto is None or s[0] < upto]
        start, paths = 0, []
        if snapshots:
            start, paths = snapshots[-1][0] + 1, [f"{self.folder}/{kind}/{snapshots[-1][1]['attempt']}"]
        commits = [c for c in self._markers("commits") if c[0] >= start and (upto is None or c[0] < upto)]
        paths += [f"{self.folder}/{kind}/{said['attempt']}" for _, said in commits]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # --- batches ---------------------------------------------------------------

    def _state(self, upto: int | None = None) -> DataFrame:
        latest = self._read("state", self.state_schema, upto).groupBy("doc", "version").agg(
            F.max(F.struct("seq", "live", "n_tokens", "source", "lang")).alias("s")
        )
        return latest.select("doc", "version", *[F.col(f"s.{f}") for f in ("source", "lang", "n_tokens", "live", "seq")])

    def current(self) -> DataFrame:
        """The latest state of each document and version."""
        return self._state().drop("seq")

    def compact(self, upto: int) -> bool:
        """Write the snapshot of all batches before a number; False if there is one."""
        attempt = f"snapshot-{uuid.uuid4().hex}"
        # documents that are gone need no row: a change of one sets its count as if it were unknown
        self._state(upto).where("live").write.parquet(f"{self.folder}/state/{attempt}")
        self._read("deltas", self.delta_schema, upto).groupBy(*GROUPS).agg(
            F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")
        ).where("d_docs <> 0 OR d_tokens <> 0").write.parquet(f"{self.folder}/deltas/{attempt}")
        return self._mark("snapshots", upto - 1, {"attempt": attempt})

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit changes (action, doc, source, lang, version, n_tokens); False if the batch has been committed."""
        if "/" in batch or not batch:
            raise ValueError(f"not a batch id: {batch!r}")
        while True:
            commits = self._markers("commits")
            if any(said["batch"] == batch for _, said in commits):
                return False
            seq, attempt = len(commits), f"{batch}-{uuid.uuid4().hex}"
            self._attempt(attempt, seq, changes)
            if self._mark("commits", seq, {"batch": batch, "attempt": attempt}):
                if (seq + 1) % self.compact_every == 0:
                    self.compact(seq + 1)
                return True

    def _attempt(self, attempt: str, seq: int, changes: DataFrame) -> None:
        """Write the state and the deltas of changes that are set against all batches before a number."""
        wanted = changes.select(
            "doc", "version", F.struct(
                (F.col("action") == DELETE).alias("gone"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"),
                F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
            ).alias("c"),
        ).groupBy("doc", "version").agg(F.max("c").alias("c"))
        old = self._state(seq).withColumnsRenamed({"doc": "doc_0", "version": "version_0"}).select(
            "doc_0", "version_0", F.struct("source", "lang", "n_tokens").alias("old"), F.col("live").alias("was")
        ) if seq else None
        if old is None:
            met = wanted.withColumns({
                "old": F.lit(None).cast("struct<source:string,lang:string,n_tokens:bigint>"), "was": F.lit(False)
            })
        else:
            same = wanted["doc"].eqNullSafe(old["doc_0"]) & wanted["version"].eqNullSafe(old["version_0"])
            met = wanted.join(old, same, "left").withColumn("was", F.coalesce("was", F.lit(False)))
        new = ~F.col("c.gone")
        state, deltas = f"{self.folder}/state/{attempt}", f"{self.folder}/deltas/{attempt}"
        met.select(
            "doc", "version", F.when(new, F.col("c.source")).otherwise(F.col("old.source")).alias("source"),
            F.when(new, F.col("c.lang")).otherwise(F.col("old.lang")).alias("lang"), F.col("c.n_tokens").alias("n_tokens"),
            new.alias("live"), F.lit(seq).cast("bigint").alias("seq"), F.when(F.col("was"), F.col("old")).alias("old"),
        ).write.parquet(state)
        done = self.spark.read.parquet(state)
        minus = F.struct(
            F.col("old.source").alias("source"), F.col("old.lang").alias("lang"), F.lit(-1).alias("d_docs"),
            (-F.col("old.n_tokens")).alias("d_tokens"),
        )
        plus = F.struct("source", "lang", F.lit(1).alias("d_docs"), F.col("n_tokens").alias("d_tokens"))
        signed = F.filter(F.array(F.when(F.col("old").isNotNull(), minus), F.when(F.col("live"), plus)), lambda d: d.isNotNull())
        (
            done.select("version", F.inline(signed)).groupBy(*GROUPS)
            .agg(F.sum("d_docs").cast("bigint").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
            .where("d_docs <> 0 OR d_tokens <> 0").write.parquet(deltas)
        )

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches."""
        return (
            self._read("deltas", self.delta_schema).groupBy(*GROUPS)
            .agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens")).where("n_docs <> 0")
        )
