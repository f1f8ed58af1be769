"""Calls of models and other external programs as injected functions.

A client is any function from a list of prompts to a list of answers.  Answers are kept in
a table by prompt hash, so a call is made once, and a stub makes tests deterministic.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import answers

Client = Callable[[list[str]], list[str]]
#: A backend turns file bytes into cells (page, table_no, row, col, raw).
Backend = Callable[[bytes], list[tuple[int, int, int, int, str]]]


def prompt_hash(prompt: str) -> str:
    return hashlib.sha256(prompt.encode()).hexdigest()


def stub(known: dict[str, str], default: str = "[]") -> Client:
    """A client that answers from a table by prompt hash."""
    return lambda prompts: [known.get(prompt_hash(p), default) for p in prompts]


def retrying(client: Client, times: int = 3, pause: float = 1.0) -> Client:
    """Tries again after pauses that double."""

    def run(prompts: list[str]) -> list[str]:
        for k in range(times):
            try:
                return client(prompts)
            except Exception:
                if k == times - 1:
                    raise
                time.sleep(pause * 2**k)
        return []

    return run


def complete(prompts: DataFrame, client: Client, batch: int = 16) -> DataFrame:
    """Answers (prompt_hash, answer) of distinct prompts (a column prompt), in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a in range(0, rows.num_rows, batch):
                part = rows.slice(a, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(client(part.column(1).to_pylist()), pa.string())], ["prompt_hash", "answer"])

    distinct = prompts.select(F.sha2("prompt", 256).alias("prompt_hash"), "prompt").distinct()
    return distinct.mapInArrow(run, "prompt_hash string, answer string")


def with_answers(rows: DataFrame, prompt: Column, client: Client, known: DataFrame | None = None) -> DataFrame:
    """Rows with the answer to a prompt; known: earlier answers, which are not asked for again."""
    asked = rows.withColumn("prompt", prompt)
    wanted = asked if known is None else asked.withColumn("prompt_hash", F.sha2("prompt", 256)).join(known.select("prompt_hash"), "prompt_hash", "left_anti").drop("prompt_hash")
    got = complete(wanted, client)
    got = got if known is None else got.unionByName(known.select("prompt_hash", "answer"))
    return asked.withColumn("prompt_hash", F.sha2("prompt", 256)).join(got, "prompt_hash", "left")


def prompt(template: str, **parts: tuple[Column, int | None]) -> Column:
    """A template with {name} filled in by columns, each cut to a number of characters (None: whole)."""
    out = F.lit(template)
    for name, (c, most) in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string") if most is None else F.left(c.cast("string"), F.lit(most)), F.lit("")))
    return out


INTELLIGENCE = "elements array<string>, methods array<string>, expected_samples int, scope string"
CLASSIFICATION = "classifications array<struct<type_id: string, confidence: double>>"


def intelligence(docs: DataFrame, client: Client, text: str = "text", most: int = 8000) -> DataFrame:
    """What to expect in a paper; nulls where the answer cannot be read."""
    rows = with_answers(docs, prompt("Scope of this paper as JSON:\n{text}", text=(F.col(text), most)), client)
    return rows.withColumn("intelligence", answers.tolerant(F.col("answer"), INTELLIGENCE)).drop("prompt", "prompt_hash", "answer")


def extract_records(tables: DataFrame, client: Client, text: str = "text", required: tuple[str, ...] = ("value",), most: int = 12_000) -> DataFrame:
    """JSON records (ord, record) that a model finds in tables."""
    rows = with_answers(tables, prompt("Records of this table as JSON:\n{text}", text=(F.col(text), most)), client)
    return rows.select(*tables.columns, F.posexplode(answers.records(F.col("answer"), required)).alias("ord", "record"))


def relevant_tables(tables: DataFrame, client: Client, text: str = "text") -> DataFrame:
    """tables that may hold data and that the model does not say no to; without an answer they stay."""
    from tablewright.operators.filters import may_be_relevant

    rows = with_answers(tables.where(may_be_relevant(F.col(text))), prompt("Does this table report data? yes or no\n{text}", text=(F.col(text), 2000)), client)
    return rows.where(~F.coalesce(F.lower(F.trim("answer")).startswith("no"), F.lit(False))).select(*tables.columns)


def classify(docs: DataFrame, client: Client, evidence: str, types: DataFrame, least: float = 0.3, most: int = 5) -> DataFrame:
    """Documents with the best of up to `most` types that a model gives with enough confidence."""
    rows = with_answers(docs, prompt("Deposit types as JSON for:\n{evidence}", evidence=(F.col(evidence), 6000)), client)
    rows = rows.withColumn("c", answers.tolerant(F.col("answer"), CLASSIFICATION)["classifications"])
    best = F.array_max(F.transform(F.slice("c", 1, most), lambda x: F.struct(x["confidence"].alias("confidence"), x["type_id"].alias("type_id"))))
    rows = rows.withColumn("b", best).withColumn("type_id", F.when(F.col("b.confidence") >= least, F.col("b.type_id"))).withColumn("confidence", F.col("b.confidence"))
    return rows.drop("prompt", "prompt_hash", "answer", "c", "b").join(types, "type_id", "left")


EVIDENCE = "host_rocks array<string>, ore_minerals array<string>, gangue_minerals array<string>, tectonic_setting string, author_classification string"


def classify_by_evidence(docs: DataFrame, client: Client, text: str, types: DataFrame, least: float = 0.3) -> DataFrame:
    """Two passes: the model first lists a paper's evidence, then ranks deposit types by that evidence alone; the result is applied (apply_classification).

    Documents whose first answer cannot be read are ranked without evidence.
    """
    first = with_answers(docs, prompt("Geological evidence of this paper as JSON:\n{text}", text=(F.col(text), None)), client)
    known = first.withColumn("evidence", answers.tolerant(F.col("answer"), EVIDENCE)).drop("prompt", "prompt_hash", "answer")
    second = with_answers(known, prompt("Deposit types with confidence as JSON for this evidence:\n{evidence}", evidence=(F.to_json("evidence"), None)), client)
    return apply_classification(second.drop("prompt", "prompt_hash"), "answer", types, least, F.col("evidence.author_classification")).drop("answer", "evidence")


def apply_classification(rows: DataFrame, answer: str, types: DataFrame, least: float = 0.3, author: Column | None = None) -> DataFrame:
    """Rows with the first of the ranked types of an answer, if the model is sure enough: deposit_type, deposit_environment, deposit_group, deposit_type_confidence,
    deposit_type_alternatives (the next four, with confidence) and deposit_type_original (what was there, or what the author says).

    types: name, environment, grp, one a name, joined by equality.  Rows keep a deposit_type that they have where the model is not sure; an answer
    that cannot be read changes nothing.
    """
    ranked = F.filter(answers.tolerant(F.col(answer), "classifications array<struct<deposit_type: string, confidence: double>>")["classifications"], lambda x: x["deposit_type"].isNotNull())
    top = F.get("__r", F.lit(0))
    had = F.col("deposit_type") if "deposit_type" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("__r", ranked).withColumn("__had", had).withColumn("__sure", F.coalesce(top["confidence"] >= least, F.lit(False)))
    rows = rows.withColumn("__name", F.when(F.col("__sure"), top["deposit_type"]))
    known = types.select(F.col("name").alias("__name"), F.col("environment").alias("deposit_environment"), F.col("grp").alias("deposit_group")).dropDuplicates(["__name"])
    others = F.array_join(F.transform(F.slice("__r", F.lit(2), F.lit(4)), lambda x: F.concat(x["deposit_type"], F.format_string(" (%.2f)", x["confidence"]))), " | ")
    changed = F.when(F.col("__sure") & (F.col("__had") != F.col("__name")), F.col("__had"))
    out = rows.drop("deposit_environment", "deposit_group").join(known, "__name", "left")
    return out.withColumns(
        {
            "deposit_type": F.coalesce("__name", "__had"),
            "deposit_type_confidence": F.when(F.col("__sure"), top["confidence"]),
            "deposit_type_alternatives": F.when(F.col("__sure") & (F.size("__r") > 1), others),
            "deposit_type_original": F.coalesce(changed, author if author is not None else F.lit(None).cast("string")),
        }
    ).drop("__r", "__had", "__sure", "__name")


def choose_backends(docs: DataFrame, client: Client, text: str, backends: list[str], default: list[str]) -> DataFrame:
    """Documents with the backends a model names, or the default."""
    rows = with_answers(docs, prompt("Which of these readers? JSON list\n{text}", text=(F.col(text), 3000)), client)
    named = F.array_intersect(answers.tolerant(F.col("answer"), "array<string>"), F.array(*map(F.lit, backends)))
    return rows.withColumn("backends", F.when(F.size(named) > 0, named).otherwise(F.array(*map(F.lit, default)))).drop("prompt", "prompt_hash", "answer")


def markdown_blocks(answer: Column) -> Column:
    """Table blocks of a vision answer: two lines and over 30 characters, or more."""
    return F.filter(F.split(answer, r"\n\s*\n"), lambda b: (F.length(b) > 30) & (F.size(F.split(F.trim(b), "\n")) >= 2) & b.contains("|"))


def page_rotation(chars: DataFrame, page: list[str]) -> DataFrame:
    """For characters (page..., angle, width, page_width, page_height): the length-weighted circular mean angle, share of rotated ones, and whether the page is landscape."""
    rad = F.radians("angle")
    mean = F.degrees(F.atan2(F.sum(F.col("width") * F.sin(rad)), F.sum(F.col("width") * F.cos(rad))))
    return chars.groupBy(*page).agg(F.round(mean, 4).alias("mean_angle"), (F.count_if(F.abs("angle") > 45) / F.count("*") > 0.5).alias("rotated"), (F.max("page_width") > 1.15 * F.max("page_height")).alias("landscape"))


@dataclass
class Correction:
    """Rounds of asking for hints and trying again, only for documents that fail."""

    attempt: Callable[[DataFrame, int], DataFrame]
    rounds: int = 2

    def run(self, first: DataFrame, key: list[str], score: str, passed: str) -> DataFrame:
        """The best version of each document; later ones replace earlier ones only if strictly better.

        first and what attempt(failing, round) gives: key..., score, passed, others alike.
        """
        best = first.withColumn("round", F.lit(0))
        for k in range(1, self.rounds + 1):
            failing = best.where(~F.col(passed))
            tried = self.attempt(failing.drop("round"), k).withColumn("round", F.lit(k))
            every = best.unionByName(tried)
            others = [c for c in every.columns if c not in key]
            pick = F.max_by(F.struct(*others), F.struct(score, (-F.col("round")).alias("r")))
            best = every.groupBy(*key).agg(pick.alias("b")).select(*key, "b.*")
        return best


def read_backend(files: DataFrame, name: str, backend: Backend) -> DataFrame:
    """Raw cells (doc_id, backend, page, table_no, row, col, raw, error) of files (doc_id, content) by a plugged-in reader; a file that it fails on has one row with the error."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(doc, name, *c, None) for c in backend(content)]
                except Exception as e:  # of any reader
                    rows.append((doc, name, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "backend", "page", "table_no", "row", "col", "raw", "error"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id string, backend string, page int, table_no int, row int, col int, raw string, error string")


def fill_cells(cells: list[str], ask: Client, describe: Callable[[str], str | None], most: int = 5) -> dict[str, str]:
    """Asks again for the cells that are not described yet, until all are or a number of rounds is over."""
    out: dict[str, str] = {}
    for _ in range(most):
        open_ = [c for c in cells if c not in out]
        if not open_:
            break
        for c, a in zip(open_, ask(open_), strict=True):
            if (d := describe(a)) is not None:
                out[c] = d
    return out
