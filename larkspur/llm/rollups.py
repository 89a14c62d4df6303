"""Token counts as delta-maintained rollups.

Events carry a sign: an insert adds a document and its tokens, a delete takes them away, a revision adds the new
count less the old one. A batch of events is summed by source, language and tokenizer version, and the sums are
written as a folder of the rollup table. Totals are the sum over the folders, so they are additive and no row is
rewritten.

A commit is idempotent and exclusive: sums are written to a folder of the writer's own, which is then renamed to the
batch's folder ``batch=<id>``. The rename is atomic and fails where the folder is there already, so that of two
writers of one batch one wins, and a writer that breaks off leaves nothing that counts. (Stores without an atomic
rename need a single writer.) ``compact`` sums the batches so far in one folder ``base=<n>``, which lists the
batches that it holds; their own folders go, and their identifiers stay known. A folder holds one row for each
group, so totals read little however many events there were.

Defined results: null sources and languages are groups of their own; a null count counts as 0; groups whose
documents have all been deleted stay with zero totals; a replayed batch changes nothing, even with other events;
an empty batch commits and adds nothing; batch identifiers may hold any characters; further columns of the events
are not read. Long texts are counted whole, repeated rows each count.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import in_batches
from larkspur.llm.tokens import VOCABULARY, Encoder

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")
_SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def counted(docs: DataFrame, texts: dict[str, str], vocabularies: dict[str, str]) -> DataFrame:
    """``docs`` without the columns in ``texts``, with the token counts that ``vocabularies`` name.

    ``vocabularies`` leads from a new column to a vocabulary, ``texts`` from a new column to the column of texts that it
    counts. A null text has 0 tokens. All texts are read in one pass.
    """
    read = sorted(set(texts.values()))
    rest = [c for c in docs.columns if c not in read]
    names = list(texts)

    def make():
        encoders = {v: Encoder(v) for v in sorted(set(vocabularies.values()))}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = {c: batch.column(len(rest) + k).to_pylist() for k, c in enumerate(read)}
            counts = [pa.array([encoders[vocabularies[n]].count(t or "") for t in columns[texts[n]]], pa.int64()) for n in names]
            return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *counts], names=[*(f"_{k}" for k in range(len(rest))), *names])

        return work

    fields = ", ".join([*(f"_{k} {dict(docs.dtypes)[c]}" for k, c in enumerate(rest)), *(f"`{n}` bigint" for n in names)])
    made = docs.select(*(F.col(f"`{c}`") for c in [*rest, *read])).mapInArrow(in_batches(make), fields)
    return made.toDF(*rest, *names)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, lang, tokenizer, n_tokens`` of every whole text (null: 0 tokens)."""
    rows = docs.select("doc_id", "source", "lang", "text")
    return counted(rows, {"n_tokens": "text"}, {"n_tokens": vocabulary}).select("doc_id", "source", "lang", F.lit(vocabulary).alias("tokenizer"), "n_tokens")


def events(kind: str, counts: DataFrame, old: str = "old_tokens", new: str = "n_tokens") -> DataFrame:
    """Signed contributions of ``counts``: kind is insert, delete or revise (which reads ``old`` and ``new``)."""
    count = F.coalesce(F.col(new), F.lit(0)).cast("bigint")
    if kind == "insert":
        docs, tokens = F.lit(1), count
    elif kind == "delete":
        docs, tokens = F.lit(-1), -count
    elif kind == "revise":
        docs, tokens = F.lit(0), count - F.coalesce(F.col(old), F.lit(0)).cast("bigint")
    else:
        raise ValueError(f"unknown kind of event: {kind}")
    return counts.select(*KEYS, docs.cast("bigint").alias("n_docs"), tokens.alias("n_tokens"))


class Rollup:
    """A rollup table at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        fs = self._files()
        if not fs.exists(self._at()):
            return []
        return sorted(n for n in (x.getPath().getName() for x in fs.listStatus(self._at())) if n.startswith(f"{kind}="))

    def _put(self, staged: str, name: str) -> bool:
        """Renames a staged folder; False if the name is taken."""
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files().getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._at(staged), self._at(name), none)
        except Py4JJavaError as failed:
            self._files().delete(self._at(staged), True)
            if "FileAlreadyExistsException" not in str(failed.java_exception):
                raise
            return False
        return True

    def _base(self) -> tuple[str | None, DataFrame]:
        """The newest base's folder and a table of the batches that it holds."""
        bases = self._names("base")
        if not bases:
            return None, self.spark.createDataFrame([], "batch string")
        return bases[-1], self.spark.read.schema("batch string").parquet(f"{self.path}/{bases[-1]}/batches")

    def _new(self, held: DataFrame, folders: list[str]) -> tuple[DataFrame, list[str]]:
        """The batches of the folders as a table, and the folders that the base does not hold: all of them, but where a
        compaction was cut off before it had deleted them."""
        named = self.spark.createDataFrame([(unquote(f.removeprefix("batch=")),) for f in folders], "batch string")
        known = {r["batch"] for r in named.join(held, "batch", "left_semi").collect()}  # some of the folders listed
        return named, [f for f in folders if unquote(f.removeprefix("batch=")) not in known]

    @staticmethod
    def _folder(batch: str) -> str:
        return f"batch={quote(batch, safe='')}"

    def committed(self, batch: str) -> bool:
        return self._files().exists(self._at(self._folder(batch))) or not self._base()[1].where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Adds a batch of signed events; False if the batch was committed before."""
        if self.committed(batch):
            return False
        sums = signed.groupBy(*KEYS).agg(*(F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in SUMS))
        staged = f"staged-{uuid.uuid4().hex}"
        sums.coalesce(1).write.parquet(f"{self.path}/{staged}")
        return self._put(staged, self._folder(batch))

    def compact(self) -> bool:
        """Sums the base and the batches after it as a new base. One process compacts at a time: a second one finds the
        base's number taken and gives up (False)."""
        base, held = self._base()
        folders = self._names("batch")
        if not folders:
            return False
        staged = f"staged-{uuid.uuid4().hex}"
        named, new = self._new(held, folders)
        self._sums(base, new).coalesce(1).write.parquet(f"{self.path}/{staged}/totals")
        held.unionByName(named).distinct().write.parquet(f"{self.path}/{staged}/batches")
        number = int(base.removeprefix("base=")) + 1 if base else 1
        if not self._put(staged, f"base={number:012d}"):
            return False
        for name in [*folders, *([base] if base else [])]:
            self._files().delete(self._at(name), True)
        return True

    def _sums(self, base: str | None, folders: list[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        paths += [f"{self.path}/{base}/totals"] if base else []
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens``: the sum over the committed batches."""
        base, held = self._base()
        folders = self._names("batch")
        return self._sums(base, self._new(held, folders)[1] if base else folders)
