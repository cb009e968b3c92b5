"""Sequence files as overlapping tiles: no record, however long, is one row.

Lines are read as Spark splits the files, wherever that is.  A line's record and place follow from sums that are kept while its block is read, and one row a
block: how many headers it has, the last of them, and how many bases stand before the first and behind the last.  A tile owns a stretch of its
record and carries some bases of its neighbours on either side, so that what fits into the overlap is found by
exactly one owner.

Defined results: bases before a file's first header belong to no record and are left out; white space inside lines is dropped, as are empty lines; records without
bases have no tile; records of the same name in several places stay apart by ``record``; gzip files are read by one task each, line by line; no files are an error of the reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mobilome.storage import materialize

#: Bases that a tile owns, and that it carries of its neighbours on either side.
TILE, OVERLAP = 1_000_000, 50_000
#: Bases to which neighbouring lines of a record are joined.
STRETCH = 50_000


_RUNS = "file string, block long, n long, head string, before long, bases string"


def _block_runs(most: int):
    """Number the lines of each block as they are read, and join neighbours of one record to rows of about ``most`` bases; behind a block's rows one without bases.

    A row has its header's number ``n`` within the block, 0 before the first, that header, and the bases of the block ``before`` it since then; the last row of
    a block has its number of headers, the last of them, and the bases behind that.  Only the open end is kept, so memory does not grow with blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, n, head, before = None, None, 0, None, 0

        def rows(columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            files, heads = (batch.column(i).cast(pa.string()) for i in (0, 2))
            blocks, bases = batch.column(1).to_numpy(zero_copy_only=False), batch.column(3).cast(pa.string())
            length = pc.utf8_length(bases).to_numpy(zero_copy_only=False).astype(np.int64)
            opens = pc.is_valid(heads).to_numpy(zero_copy_only=False)
            other = np.ones(size, bool)  # lines of another block than the one before
            other[1:] = (blocks[1:] != blocks[:-1]) | pc.not_equal(files.slice(1), files.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            other[0] = file != files[0].as_py() or block != blocks[0]
            starts = np.flatnonzero(other | opens)
            since = np.cumsum(length) - length
            run_of = np.searchsorted(starts, np.arange(size), "right") - 1  # -1: goes on from the batch before
            inside = since - np.where(run_of >= 0, since[starts[run_of]] if len(starts) else 0, -before)
            first = other | opens
            first[0] = True
            first[1:] |= inside[1:] // most != inside[:-1] // most
            at = np.flatnonzero(first)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, size), pa.int32()), bases), "")
            out: list[list] = [[] for _ in _NAMES]

            def close() -> None:
                for column, value in zip(out, (file, block, n, head, before, None)):
                    column.append(value)

            sums = np.add.reduceat(length, at)
            for i, text, bases_here in zip(at.tolist(), joined, sums.tolist()):
                if other[i]:
                    if file is not None:
                        close()
                    file, block, n, head, before = files[i].as_py(), int(blocks[i]), 0, None, 0
                if opens[i]:
                    n, head, before = n + 1, heads[i].as_py(), 0
                if bases_here:
                    for column, value in zip(out, (file, block, n, head, before, text.as_py())):
                        column.append(value)
                before += bases_here
            yield rows(out)
        if file is not None:
            yield rows([[file], [block], [n], [head], [before], [None]])

    return run


_NAMES = [c.split()[0] for c in _RUNS.split(", ")]
_TYPES = [pa.string() if c.endswith(" string") else pa.int64() for c in _RUNS.split(", ")]


def sequence_lines(spark: SparkSession, path: str, most: int = STRETCH) -> DataFrame:
    """(record, contig_id, description, offset, bases): the lines of all records, neighbours joined to about ``most`` bases, with the place of their first base."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("value"),
    )
    header = F.startswith(F.col("value"), F.lit(">"))
    text = raw.select("file", "block", F.when(header, F.trim(F.substr("value", F.lit(2)))).alias("head"), F.when(header, "").otherwise(F.regexp_replace("value", r"\s+", "")).alias("bases"))
    # A block is read by one task from end to end, so its lines are numbered while they pass, without sorting them.
    runs = materialize(text.mapInArrow(_block_runs(most), _RUNS), "sequence-lines")
    # One row a block from here on.
    joined = runs.filter("bases IS NULL").select("file", "block", F.col("n").alias("heads"), F.col("head").alias("last_head"), F.col("before").alias("tail"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("heads_before", F.coalesce(F.sum("heads").over(order), F.lit(0))).withColumn("open_head", F.last("last_head", ignorenulls=True).over(order))
    # A block without a header goes on with the record of the block before.
    since = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ran = joined.withColumn("run", F.sum(F.when(F.col("heads") > 0, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block")))
    # The first block of a run holds its header, whose tail counts for the blocks after it; what precedes the header belongs to the run before.
    carried = ran.withColumn("carry_here", F.coalesce(F.sum("tail").over(since), F.lit(0)))
    previous = Window.partitionBy("file").orderBy("block")
    carry = F.when(F.col("heads") == 0, F.col("carry_here")).otherwise(F.coalesce(F.lag(F.col("carry_here") + F.col("tail")).over(previous), F.lit(0)))
    # Written, so that its size is known and it meets the lines without a shuffle of theirs unless it is large itself.
    starts = materialize(carried.select("file", "block", "heads_before", "open_head", carry.alias("carry")), "sequence-blocks")
    placed = runs.filter("bases IS NOT NULL").join(starts, ["file", "block"])
    description = F.when(F.col("n") > 0, F.col("head")).otherwise(F.col("open_head"))
    number = F.col("heads_before") + F.col("n")
    return placed.filter(number > 0).select(
        F.concat_ws("#", "file", number).alias("record"), F.regexp_extract(description, r"^(\S*)", 1).alias("contig_id"), description.alias("description"),
        (F.col("before") + F.when(F.col("n") > 0, 0).otherwise(F.col("carry"))).alias("offset"), "bases",
    )


def read_tiles(spark: SparkSession, path: str, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """(record, contig_id, tile, start, own_start, own_end, at_end, sequence): tiles of all records.

    ``start`` is the place of the sequence's first base; the tile owns [own_start, own_end); ``at_end`` says that it reaches the end of its record.
    """
    lines = sequence_lines(spark, path).withColumn("stop", F.col("offset") + F.length("bases"))
    first, last = F.greatest(F.lit(0), F.floor((F.col("offset") - overlap) / tile)), F.floor((F.col("stop") - 1 + overlap) / tile)
    dealt = lines.withColumn("tile", F.explode(F.sequence(first, last)))
    # Of a line only what the tile sees, so that rows stay short however long lines are.
    low, high = F.greatest(F.lit(0), F.col("tile") * tile - overlap), (F.col("tile") + 1) * tile + overlap
    a, z = F.greatest("offset", low), F.least("stop", high)
    seen = dealt.filter(a < z).select("record", "contig_id", "tile", a.alias("a"), F.substring(F.col("bases"), (a - F.col("offset") + 1).cast("int"), (z - a).cast("int")).alias("part"), "stop")
    # At most a tile and its overlaps in one group.
    parts = F.array_sort(F.collect_list(F.struct("a", "part")))
    tiles = seen.groupBy("record", "contig_id", "tile").agg(F.min("a").alias("start"), F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("sequence"))
    ends = lines.groupBy(F.col("record").alias("_r")).agg(F.max("stop").alias("size"))
    joined = tiles.join(ends, F.col("record") == F.col("_r"))
    own_start, own_end = F.col("tile") * tile, F.least("size", (F.col("tile") + 1) * tile)
    at_end = F.col("start") + F.length("sequence") == F.col("size")
    return joined.filter(own_start < F.col("size")).select("record", "contig_id", "tile", "start", own_start.alias("own_start"), own_end.alias("own_end"), at_end.alias("at_end"), "sequence")


FRAMES = "record string, contig_id string, start long, end long, strand string, partial_left boolean, partial_right boolean, protein string"


def find_genes_in_tiles(tiles: DataFrame, least: int = 90) -> DataFrame:
    """The reading frames of ``scan.find_genes``, each found by the tile that owns its first base; gene ids count along each record.

    A frame that a tile cuts short on a side where the record goes on is another tile's; if the owner of its first base is
    the one that cuts it, the overlap is too small for the frames of this record, which is an error and no shorter frame.
    """
    from mobilome.operators.scan import reading_frames

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                size = len(t.sequence)
                for a, z, strand, left, right, protein in reading_frames(t.sequence.upper(), least):
                    cut_left, cut_right = t.start > 0 and a < 3, not t.at_end and z > size - 3
                    start, end = a + t.start, z + t.start
                    if cut_left and end > t.own_start or cut_right and start < t.own_end:
                        raise ValueError(f"{t.contig_id}: a frame of {z - a} bases at {start} is longer than the overlap of tiles")
                    if not cut_left and not cut_right and t.own_start <= start < t.own_end:
                        rows.append((t.record, t.contig_id, start, end, strand, left, right, protein))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FRAMES.split(", ")])

    found = tiles.mapInPandas(run, FRAMES)
    # The genes of one record, without its bases.
    place = F.row_number().over(Window.partitionBy("record").orderBy("start", "end", "strand", "partial_left", "partial_right", "protein"))
    return found.withColumn("gene_id", F.concat_ws("_", "contig_id", place)).select(
        "contig_id", "gene_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "strand", "partial_left", "partial_right", "protein"
    )
