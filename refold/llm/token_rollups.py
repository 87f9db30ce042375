"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch of changes is a set of rows (source, lang, tokenizer, tokens_before, tokens_after): an insert
has no before, a delete no after, a revision both. Each gives signed document and token counts, which
are summed map-side before the only shuffle, so that a source with a third of all rows still sends a
few rows from each task. What is stored for a batch is its few totals, never its documents.

A batch commits by one rename of a whole folder to `batch=<id>`. If that folder is there already, the
batch has been committed and its second delivery is dropped; a writer that dies before the rename
leaves only a draft, which readers don't see. Totals are sums over committed batches.

Edge cases: null sources and languages are groups of their own; null texts count 0 tokens; repeated
rows count each; an empty batch commits and adds nothing; totals that cancel to zero documents and
zero tokens are left out.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import encoder, slices

KEYS = ("source", "lang", "tokenizer")
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def counted(docs: DataFrame, tokenizers: dict[str, str], extra: int = 0) -> DataFrame:
    """A row (source, lang, tokenizer, tokens) for each document and tokenizer version. tokenizers:
    version -> file. extra: ids added to each document, such as an end token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for version, path in tokenizers.items():
                _, at = encoder(path).column(b.column("text"))
                yield pa.record_batch([b.column("source"), b.column("lang"), pa.array([version] * b.num_rows, pa.string()), pa.array(np.diff(at) + extra)], names=["source", "lang", "tokenizer", "tokens"])

    text = [F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")]
    return docs.select(*text).mapInArrow(count, "source string, lang string, tokenizer string, tokens long")


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(None).cast("long").alias("tokens_before"), F.col("tokens").alias("tokens_after"))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.col("tokens").alias("tokens_before"), F.lit(None).cast("long").alias("tokens_after"))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed totals of a batch of changes."""
    before, after = F.col("tokens_before"), F.col("tokens_after")
    sign = after.isNotNull().cast("long") - before.isNotNull().cast("long")
    signed = changes.select(*KEYS, sign.alias("n_docs"), (F.coalesce(after, F.lit(0)) - F.coalesce(before, F.lit(0))).cast("long").alias("n_tokens"))
    return signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollups:
    """The committed batches under a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds the batch; False if it has been committed before. batch_id: letters, digits, - and _."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        final = self._at(f"batch={batch_id}")
        if self.fs.exists(final):
            return False
        draft = f"_draft-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.path}/{draft}")
        # a rename onto a folder that appeared meanwhile would nest the draft in it: that delivery came first
        done = not self.fs.exists(final) and self.fs.rename(self._at(draft), final)
        if not done or self.fs.exists(self._at(f"batch={batch_id}/{draft}")):
            self.fs.delete(self._at(f"batch={batch_id}/{draft}"), True)
            self.fs.delete(self._at(draft), True)
            return False
        return True

    def batches(self) -> list[str]:
        if not self.fs.exists(self._hadoop.Path(self.path)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._hadoop.Path(self.path))]
        return sorted(n[6:] for n in names if n.startswith("batch="))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        folders = [f"{self.path}/batch={b}" for b in self.batches()]
        rows = self.spark.read.schema(DELTAS).parquet(*folders) if folders else self.spark.createDataFrame([], DELTAS)
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))
