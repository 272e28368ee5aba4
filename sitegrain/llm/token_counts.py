"""Operator 5 — token counts of flat, unindexed token files, by a separator scan.

A token file is nothing but little-endian 16-bit ids, each document followed
by the end-of-document id. Counting needs no index: every file is cut into
blocks of a fixed number of tokens, each block is searched for the end id with
one vectorised comparison, and boundaries that span blocks are stitched by a
prefix scan over the blocks' summaries (how many ends, and how many tokens
after the last). Blocks of all files are one table, so a single huge file is
read by as many tasks as a thousand small ones.

``write_flat_files`` writes such files from documents, in any order, and a
manifest that names the document of each ordinal in a file (the ids, not the
places or lengths). What the scan knows of a file is its size in the store's
listing. The special-token strings of the vocabulary are encoded as ordinary
text there, so the end id never comes from a text.

Defined results: tokens after a file's last end id are no document and are
counted as the file's tail; two end ids in a row enclose an empty document; an
empty file has no documents; a null text is an empty document; repeated rows
are documents each; an empty table gives no files and an empty result; a very
long text spans as many blocks as it needs. Only id and text are read, so
further columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, table, text_batches
from .word_bpe import END_ID, ordinary_encoder, tokenizer_path

BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 24  # a file is closed once it holds so many
GROUP_BLOCKS = 4096  # blocks of a file whose prefix sums one task makes


def write_flat_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """Writes the files; returns (files: path, tokens), listed anew, and (manifest: name, ordinal, doc_id)."""
    text_batches(docs.sparkSession)
    path, kind = tokenizer or tokenizer_path(), docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        enc, context, tail = ordinary_encoder(path), TaskContext.get(), np.array([end], "<u2").tobytes()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, held, out, name = 0, 0, None, ""

        def close() -> None:
            out.close()
            if store.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:  # of an earlier attempt; not every store's rename replaces
                store.delete_file(f"{base}/{name}")
            store.move(f"{base}/{name}.{context.taskAttemptId()}", f"{base}/{name}")

        ordinal = 0
        for b in batches:
            names, ordinals = [], []
            for raw in enc.encode(b.column(1).to_pylist()):
                if out is None:
                    name, ordinal, held = f"tokens-{context.partitionId():06d}-{part:04d}.bin", 0, 0
                    out = store.open_output_stream(f"{base}/{name}.{context.taskAttemptId()}")
                out.write(raw + tail)
                names.append(name)
                ordinals.append(ordinal)
                ordinal, held = ordinal + 1, held + len(raw) // 2 + 1
                if held >= FILE_TOKENS:
                    close()
                    out, part = None, part + 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ordinals, pa.int64()), b.column(0)], ["name", "ordinal", "doc_id"])
        if out is not None:
            close()

    schema = f"name string, ordinal bigint, doc_id {kind.simpleString()}"
    manifest = materialise(docs.select("doc_id", "text").mapInArrow(run, schema), "manifest")
    if manifest.isEmpty():
        return docs.sparkSession.createDataFrame([], "path string, tokens bigint"), manifest
    return list_files(docs.sparkSession, folder), manifest


def list_files(spark, folder: str) -> DataFrame:
    """``(path, tokens)`` of token files already there, from any store that Spark reads; no content is read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    return listed.select("path", F.floor(F.col("length") / 2).alias("tokens"))


def blocks_of(files: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(path, block, first, size)``: the files cut into blocks of tokens."""
    n = F.ceil(F.col("tokens") / block_tokens)
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1))
    return files.select("path", "tokens", F.explode(starts).alias("block")).select(
        "path",
        "block",
        (F.col("block") * block_tokens).alias("first"),
        F.least(F.lit(block_tokens), F.col("tokens") - F.col("block") * block_tokens).alias("size"),
    )


def scan_blocks(blocks: DataFrame, end: int = END_ID) -> DataFrame:
    """One row a block: path, block, first, size and ends, the positions after its end ids, counted from the block's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path, block, first, size in zip(*(c.to_pylist() for c in b.columns)):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    f.seek(2 * first)
                    tokens = np.frombuffer(f.read(2 * size), "<u2")
                ends = np.flatnonzero(tokens == end) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block]), pa.array([first]), pa.array([size]), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                    ["path", "block", "first", "size", "ends"],
                )

    n = max(1, min(10_000, blocks.count()))
    return blocks.repartition(n, "path", "block").mapInArrow(run, "path string, block bigint, first bigint, size bigint, ends array<bigint>")


def document_counts(files: DataFrame, block_tokens: int = BLOCK_TOKENS, end: int = END_ID) -> DataFrame:
    """``(path, ordinal, start, n_tokens)`` of every document of the files; n_tokens leaves out the end id."""
    scanned = materialise(scan_blocks(blocks_of(files, block_tokens), end), "scanned")
    # prefix scan in two steps, over groups of a file's blocks and inside them: ends before the block, and where the last of them stood
    last = F.when(F.size("ends") > 0, F.col("first") + F.element_at("ends", -1))
    summed = scanned.select("path", "block", F.floor(F.col("block") / GROUP_BLOCKS).alias("group"), F.size("ends").cast("bigint").alias("n"), last.alias("last"))
    groups = summed.groupBy("path", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    over = Window.partitionBy("path").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("path", "group", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("ends_before"), F.coalesce(F.max("last").over(over), F.lit(0)).alias("open_before"))
    before = Window.partitionBy("path", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = summed.select(
        "path", "group", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.max("last").over(before), F.lit(0)).alias("last")
    )
    summed = summed.join(groups, ["path", "group"]).select(
        "path", "block", (F.col("ends_before") + F.col("n")).alias("ordinal"), F.greatest("open_before", "last").alias("open")
    )
    stitched = scanned.join(summed, ["path", "block"])
    ends = F.posexplode("ends").alias("i", "end")
    rows = stitched.select("path", "ordinal", "open", "first", "ends", ends)
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("first") + F.get("ends", F.col("i") - 1))
    return rows.select(
        "path",
        (F.col("ordinal") + F.col("i")).alias("ordinal"),
        start.cast("bigint").alias("start"),
        (F.col("first") + F.col("end") - 1 - start).cast("bigint").alias("n_tokens"),
    )


def tails(files: DataFrame, counts: DataFrame) -> DataFrame:
    """``(path, documents, tail)``: tokens of each file after its last end id."""
    ends = counts.groupBy("path").agg(F.count("*").alias("documents"), F.max(F.col("start") + F.col("n_tokens") + 1).alias("stop"))
    return files.join(ends, "path", "left").select(
        "path", F.coalesce("documents", F.lit(0)).alias("documents"), (F.col("tokens") - F.coalesce("stop", F.lit(0))).alias("tail")
    )


def of_documents(counts: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens)``: the counts with the documents that the manifest names; files are matched by name."""
    named = counts.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named.join(manifest, ["name", "ordinal"]).select("doc_id", "n_tokens")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by scanning flat files written from all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files, manifest = write_flat_files(docs, f"{shared_dir(spark)}/flat")
    return of_documents(document_counts(files), manifest)
