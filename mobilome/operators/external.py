"""Search programs on the executors: any program that reads FASTA and writes a table can stand behind these functions.

Each batch of a partition becomes one call of the program in a folder of its own, which is removed after it,
whatever happens.  Nothing but the parsed rows leaves the task.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame


class ToolError(RuntimeError):
    """A program that is missing, fails, or takes too long, with its command and what it said."""

    def __init__(self, tool: str, detail: str, command: Sequence[str] = (), stdout: str = "", stderr: str = ""):
        self.tool, self.detail, self.command, self.stdout, self.stderr = tool, detail, tuple(command), stdout, stderr
        said = f"; command: {' '.join(self.command)}" if self.command else ""
        super().__init__(f"{tool}: {detail}{said}{f'; stderr: {stderr.strip()}' if stderr else ''}")

    def __reduce__(self):
        return ToolError, (self.tool, self.detail, self.command, self.stdout, self.stderr)


def resolve(program: str, explicit: str | None = None) -> str:
    """The path of an executable, given or found on the search path."""
    found = shutil.which(explicit or program)
    if found is None:
        raise ToolError(program, f"no executable at {explicit}" if explicit else "no executable on the search path")
    return os.path.realpath(found)


def call(tool: str, command: Sequence[str], folder: str, seconds: float) -> str:
    """Run a command in a folder and give its output; failure and time-out are errors."""
    try:
        done = subprocess.run(list(command), cwd=folder, capture_output=True, text=True, errors="replace", timeout=seconds)
    except subprocess.TimeoutExpired as e:
        raise ToolError(tool, f"no end within {seconds:g} s", command) from e
    except OSError as e:
        raise ToolError(tool, str(e), command) from e
    if done.returncode:
        raise ToolError(tool, f"exit status {done.returncode}", command, done.stdout, done.stderr)
    return done.stdout


#: A runner gets a folder that holds queries.fa and gives the rows it found.
Runner = Callable[[str], pd.DataFrame]

#: Columns of the tables that search programs write.
HITS = "query string, target string, fident double, alnlen int, qcov double, tcov double, evalue double, bits double"
BLAST = "query string, target string, pident double, alnlen int, qcovs double, evalue double, bits double"
PROFILE_HITS = "query string, profile string, evalue double, bits double, domain_evalue double, domain_bits double"


def search(sequences: DataFrame, id_col: str, sequence: str, runner: Runner, schema: str) -> DataFrame:
    """What ``runner`` finds for every batch of sequences, each in a folder of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["s"].fillna("") != ""]
            if not len(pdf):
                continue
            with tempfile.TemporaryDirectory() as folder:
                Path(folder, "queries.fa").write_text("".join(f">{i}\n{s}\n" for i, s in zip(pdf["i"], pdf["s"])))
                yield runner(folder)

    rows = sequences.select(sequences[id_col].cast("string").alias("i"), sequences[sequence].alias("s"))
    return rows.mapInPandas(run, schema)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def table_runner(tool: str, command: Sequence[str], schema: str, output: str, explicit: str | None = None, seconds: float = 3600, strict: bool = True) -> Runner:
    """A runner for a program that writes a tab-separated table without a header.

    In ``command``, {tool}, {queries} and {output} stand for the executable and the two files.
    """
    names = _names(schema)

    def run(folder: str) -> pd.DataFrame:
        words = {"tool": resolve(tool, explicit), "queries": f"{folder}/queries.fa", "output": f"{folder}/{output}"}
        call(tool, [c.format(**words) for c in command], folder, seconds)
        rows = [line.split("\t") for line in Path(folder, output).read_text().splitlines() if line.strip()]
        return _typed(tool, command, rows, names, schema, strict)

    return run


def profile_runner(database: str, explicit: str | None = None, tool: str = "hmmsearch", seconds: float = 3600, threads: int = 1, strict: bool = True) -> Runner:
    """A runner for a profile search that writes a table split by white space, # lines being comments."""
    names = _names(PROFILE_HITS)

    def run(folder: str) -> pd.DataFrame:
        out = f"{folder}/hits.tbl"
        call(tool, [resolve(tool, explicit), "--noali", "--cpu", str(threads), "--tblout", out, database, f"{folder}/queries.fa"], folder, seconds)
        rows = [line.split() for line in Path(out).read_text().splitlines() if line.strip() and not line.startswith("#")]
        picked = [[r[i] for i in (0, 2, 4, 5, 7, 8)] if len(r) > 8 else r[:1] for r in rows]
        return _typed(tool, [tool, database], picked, names, PROFILE_HITS, strict)

    return run


def _typed(tool: str, command: Sequence[str], rows: list[list[str]], names: list[str], schema: str, strict: bool) -> pd.DataFrame:
    """Rows as a frame of the schema's types; a row that is not of them is an error, or is left out if ``strict`` is off."""
    kinds = [{"string": str, "int": int, "double": float}[c.split()[1]] for c in schema.split(", ")]
    out = []
    for r in rows:
        try:
            if len(r) < len(names):
                raise ValueError(f"{len(r)} columns")
            out.append([kind(x) for kind, x in zip(kinds, r)])
        except ValueError as e:
            if strict:
                raise ToolError(tool, f"a row that is not ({schema}): {' '.join(r)}", command) from e
    return pd.DataFrame(out, columns=names)


def similarity_runner(database: str, explicit: str | None = None, tool: str = "mmseqs", sensitivity: float = 7.5, seconds: float = 3600, strict: bool = True) -> Runner:
    """A runner for a sequence search against a database, with the eight usual columns."""
    command = ["{tool}", "easy-search", "{queries}", database, "{output}", "scratch", "-s", str(sensitivity), "--format-output", ",".join(_names(HITS))]
    return table_runner(tool, command, HITS, "hits.tsv", explicit, seconds, strict)


def blast_runner(database: str, explicit: str | None = None, tool: str = "blastp", seconds: float = 3600, strict: bool = True) -> Runner:
    """A runner for a protein search with the best target of every query."""
    columns = "6 qseqid sseqid pident length qcovs evalue bitscore"
    command = ["{tool}", "-query", "{queries}", "-db", database, "-out", "{output}", "-max_target_seqs", "1", "-outfmt", columns]
    return table_runner(tool, command, BLAST, "hits.tsv", explicit, seconds, strict)


def align_families(proteins: DataFrame, family: str, id_col: str, sequence: str, explicit: str | None = None, tool: str = "mafft", least: int = 3, seconds: float = 3600) -> DataFrame:
    """(family, id, aligned) of every family of at least ``least`` members; a family is one call, as an alignment must be."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < least:
            return pd.DataFrame({"family": [], "id": [], "aligned": []}, dtype=object)
        with tempfile.TemporaryDirectory() as folder:
            pdf = pdf.sort_values("i")
            Path(folder, "members.fa").write_text("".join(f">{i}\n{s}\n" for i, s in zip(pdf["i"], pdf["s"])))
            text = call(tool, [resolve(tool, explicit), "--auto", "--quiet", f"{folder}/members.fa"], folder, seconds)
        records = [r.split("\n", 1) for r in text.split(">") if r.strip()]
        return pd.DataFrame({"family": [pdf["f"].iloc[0]] * len(records), "id": [r[0].split()[0] for r in records], "aligned": [r[1].replace("\n", "") for r in records]})

    rows = proteins.select(proteins[family].alias("f"), proteins[id_col].cast("string").alias("i"), proteins[sequence].alias("s"))
    return rows.groupBy("f").applyInPandas(run, "family string, id string, aligned string")
