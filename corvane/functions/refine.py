"""Refinement: parsing a language model's structured answer, composing the refined text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.embed import let
from corvane.functions.text import is_blank, strip, truncate_words

# The answer's field names (lower case), words for yes, and limits.
INTENT_FIELDS = ("intención", "intencion")
TERM_FIELDS = ("términos", "terminos", "entidades")
QUESTION_FIELDS = ("tiene_pregunta",)
SUMMARY_FIELDS = ("resumen",)
YES = ("SI", "SÍ", "YES", "TRUE", "1")
STOP_TOKENS = ("<|im_end|>", "<|im_start|>", "\n\n\n")
SHOWN_ENTITIES, FALLBACK_CHARS, INPUT_CHARS = 8, 500, 1500
REFINE_CHARS, REVECTORIZE_CHARS = 6000, 8000
#: Prompts that a model gets in one call.
BATCH_PROMPTS = 32
QUANTISATIONS = {"q4_0": 2000, "q4_k_m": 2200, "q5_k_m": 2800, "q8_0": 3500}
DEFAULT_QUANTISATION = "q4_k_m"

REFINED = "refined_content string, intent string, entities array<string>, summary string, confidence double, has_question boolean"

#: A language model: prompts and stop tokens in, an answer per prompt out.
LanguageModel = Callable[[list[str], tuple[str, ...]], list[str]]


def _field(line: Column, names: tuple[str, ...]) -> Column:
    """The value if the line begins with one of the names and a colon, else null."""
    pattern = rf"(?iuU)^(?:{'|'.join(names)}):\s*(.*)$"
    return F.when(F.rlike(line, F.lit(pattern)), strip(F.regexp_extract(line, pattern, 1)))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"\A[\[\]]+|[\[\]]+\z", "")


def parse_answer(answer: Column, original: Column) -> Column:
    """The refined struct of one answer.

    Lines are folded in order: a later intent, summary or comma list replaces an
    earlier one; lines with a dash right after an empty term field add terms, until a
    blank or another line ends the block.  Nothing understood: the original's first
    500 characters at 0.3, else the fields joined at 0.9.
    """
    lines = F.transform(F.split(answer, "\n"), strip)
    start = F.struct(
        F.lit(None).cast("string").alias("intent"),
        F.array().cast("array<string>").alias("entities"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(False).alias("question"),
        F.lit(False).alias("block"),
    )

    def step(acc: Column, line: Column) -> Column:
        fields = F.struct(*[_field(line, n).alias(k) for k, n in (("intent", INTENT_FIELDS), ("terms", TERM_FIELDS), ("question", QUESTION_FIELDS), ("summary", SUMMARY_FIELDS))])
        return let(fields, lambda f: taken(acc, line, f["intent"], f["terms"], f["question"], f["summary"]))

    def taken(acc: Column, line: Column, intent: Column, terms: Column, question: Column, summary: Column) -> Column:
        dash = acc["block"] & F.startswith(line, F.lit("-"))
        item = strip(F.regexp_replace(line, r"\A[- ]+", ""))
        listed = F.filter(F.transform(F.split(_bare(terms), ","), strip), lambda e: e != "")
        is_terms = ~dash & intent.isNull() & terms.isNotNull()
        is_summary = ~dash & intent.isNull() & terms.isNull() & question.isNull() & summary.isNotNull()
        return F.struct(
            F.when(~dash & intent.isNotNull(), _bare(intent)).otherwise(acc["intent"]).alias("intent"),
            F.when(dash & (item != ""), F.concat(acc["entities"], F.array(item))).when(is_terms & (_bare(terms) != ""), listed).otherwise(acc["entities"]).alias("entities"),
            F.when(is_summary, summary).otherwise(acc["summary"]).alias("summary"),
            F.when(~dash & intent.isNull() & terms.isNull() & question.isNotNull(), F.upper(question).isin(*YES)).otherwise(acc["question"]).alias("question"),
            (dash | (is_terms & (_bare(terms) == ""))).alias("block"),
        )

    # folded once: inside a branch a plain expression is computed anew for each field that is taken of it
    return let(F.aggregate(lines, start, step), lambda found: compose(found["intent"], found["entities"], found["summary"], found["question"], original))


def compose(intent: Column, entities: Column, summary: Column, question: Column, original: Column) -> Column:
    """The refined struct out of its fields; eight entities are shown at most."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    shown = F.array_join(F.slice(entities, 1, SHOWN_ENTITIES), ", ")
    some = F.coalesce(F.size(entities) > 0, F.lit(False))
    joined = F.concat_ws(" | ", F.when(filled(intent), F.concat(F.lit("Intención: "), intent)), F.when(some, F.concat(F.lit("Términos: "), shown)), F.when(filled(summary), F.concat(F.lit("Resumen: "), summary)))
    parsed = joined != ""
    return F.struct(
        F.when(parsed, joined).otherwise(F.left(original, F.lit(FALLBACK_CHARS))).alias("refined_content"),
        intent.alias("intent"),
        entities.alias("entities"),
        summary.alias("summary"),
        F.when(parsed, 0.9).otherwise(0.3).alias("confidence"),
        question.alias("has_question"),
    )


def refine_with(df: DataFrame, load: Callable[[], LanguageModel], prompt: str, text: str = "vectorizable_content", chars: int = INPUT_CHARS, side: str = "right") -> DataFrame:
    """Adds the struct `refined`: the model's answer to prompt.format(text=...), parsed.

    load() runs once per Python worker; the model gets up to BATCH_PROMPTS prompts a call.
    A blank text gives '' at 0.0.  If a call fails, its prompts are asked one by one, and
    those that fail alone give the first 500 characters at 0.0.
    """

    def answers(model: LanguageModel, prompts: list[str]) -> list[tuple[str | None, bool]]:
        try:
            return [(answer.strip(), False) for answer in model(prompts, STOP_TOKENS)]
        except Exception:  # noqa: BLE001  whatever the model raises, the rows fall back
            return [(None, True)] if len(prompts) == 1 else [x for p in prompts for x in answers(model, [p])]

    @F.pandas_udf("answer string, failed boolean")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            out: list[tuple[str | None, bool]] = [(None, False)] * len(texts)
            full = [k for k, t in enumerate(texts) if t is not None and t.strip()]
            for i in range(0, len(full), BATCH_PROMPTS):
                some = full[i : i + BATCH_PROMPTS]
                for k, x in zip(some, answers(model, [prompt.replace("{text}", texts.iloc[k]) for k in some]), strict=True):
                    out[k] = x
            yield pd.DataFrame(out, columns=["answer", "failed"])

    c = F.col(text)
    asked = df.withColumn("_cut", truncate_words(c, chars, side)).withColumn("_asked", ask("_cut"))
    none = lambda content: F.struct(content.alias("refined_content"), F.lit(None).cast("string").alias("intent"), F.array().cast("array<string>").alias("entities"), F.lit(None).cast("string").alias("summary"), F.lit(0.0).alias("confidence"), F.lit(False).alias("has_question"))
    refined = F.when(is_blank(c), none(F.lit(""))).when(F.col("_asked.failed"), none(F.left("_cut", F.lit(FALLBACK_CHARS)))).otherwise(parse_answer(F.col("_asked.answer"), c))
    return asked.withColumn("refined", refined).withColumn("refined_content", F.col("refined.refined_content")).drop("_cut", "_asked")


def echo_model(prompts: list[str], stop: tuple[str, ...]) -> list[str]:
    """A stand-in model: of the text below the prompt's first line the first words as intent and summary, the longest as terms."""
    out = []
    for p in prompts:
        words = (p.partition("\n")[2] or p).split()
        terms = sorted(dict.fromkeys(t for t in (w.strip(",.;") for w in words) if t), key=lambda w: (-len(w), w))[:3]
        out.append(f"Intención: {' '.join(words[:3])}\nTérminos: {', '.join(terms)}\nResumen: {' '.join(words[:12])}")
    return out


def semantic_keywords(intent: Column, entities: Column, summary: Column) -> Column:
    """Words for full-text search: intent, entities with parentheses as spaces, summary."""
    clean = F.transform(F.coalesce(entities, F.array().cast("array<string>")), lambda e: F.trim(F.translate(e, "()", "  ")))
    filled = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", filled(intent), F.when(F.size(clean) > 0, F.array_join(clean, " ")), filled(summary))


def quantisation(file_name: str) -> str:
    """The quantisation that a model file's name tells; hyphens and underscores don't count."""
    bare = lambda x: x.lower().replace("-", "").replace("_", "")
    return next((q for q in QUANTISATIONS if bare(q) in bare(file_name)), DEFAULT_QUANTISATION)


def model_info(file_name: str, loaded: bool = False) -> dict:
    """What is known of a model file: its name, quantisation, memory by estimate in MB, and whether it is loaded."""
    kind = quantisation(file_name)
    return {"model": file_name.rpartition("/")[2], "quantisation": kind, "memory_mb": QUANTISATIONS[kind], "loaded": loaded}
