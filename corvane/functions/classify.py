"""Intent rules, topics, and the frame for pluggable classifiers."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.embed import let
from corvane.functions.text import is_blank, strip
from corvane.schema import with_flags

# Rule patterns, stopwords and zero-shot labels.
QUESTION = (
    r"\?$",
    r"^(what|where|when|why|who|how|which|can|could|would|should|is|are|do|does)",
    r"(please|could you|can you|would you) (help|tell|explain|show)",
)
COMMAND = (
    r"^(create|make|build|generate|write|implement|add|fix|update|change|modify)",
    r"^(show|display|list|find|search|get|fetch|retrieve)",
    r"^(delete|remove|clear|reset|clean)",
    r"(please|kindly) (create|make|build|generate|write)",
)
SOCIAL = (
    r"^(hi|hello|hey|thanks|thank you|ok|okay|yes|no|sure|great|cool)",
    r"^(lol|haha|nice|awesome|perfect|excellent)",
)
STOPWORDS = ("this", "that", "these", "those", "what", "which", "who", "have", "been", "were", "said", "from", "they", "with")
SHORT_STOPWORDS = ("this", "that", "these", "those", "what", "which", "who")
ZERO_SHOT_LABELS = {
    "asking a question": "question_explicit",
    "following up on previous answer": "question_followup",
    "requesting an action or task": "command",
    "sharing knowledge or information": "knowledge_share",
    "casual conversation": "social",
}
HYPOTHESIS = "This text is {}."
CLASSIFIER_CHARS, MAX_TOPICS = 2000, 5


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.rlike(c, F.lit(f"(?d){p}")) for p in patterns])  # one by one: an anchored pattern alone is tried at its place only


def rule_intent(text: Column) -> Column:
    """struct(intent, confidence, rule): the first rule that fits."""
    few = F.size(F.split(strip(text), r"(?U)[\s\x1C-\x1F]+", 5)) < 5
    result = lambda intent, confidence, rule: F.struct(F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"), F.lit(rule).cast("string").alias("rule"))

    def of(low: Column) -> Column:
        return (
            F.when(is_blank(text), result("social", 0.5, None))
            .when(_any(low, QUESTION), result("question_explicit", 0.85, "question_pattern"))
            .when(_any(low, COMMAND), result("command", 0.80, "command_pattern"))
            .when(_any(low, SOCIAL), result("social", 0.75, "social_pattern"))
            .when(few, result("social", 0.60, "short_text"))
            .otherwise(result("knowledge_share", 0.70, "default"))
        )

    return let(strip(F.lower(text)), of)


def topic_words(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Words of four or more letters a-z in order of the text, without stopwords."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])([a-z]{4,}+)(?![\p{L}\p{N}_])"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*stopwords))


def top_words(words: Column, n: int = MAX_TOPICS) -> Column:
    """The n most frequent of an array, the first seen of equals first: sorted once, then counted by the borders of equal runs."""
    def ranked(s: Column) -> Column:
        borders = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]))
        run = lambda b: F.transform(b, lambda at, k: F.struct((at - F.coalesce(F.get(b, k + 1), F.size(s))).alias("n"), F.get(s, at)["i"].alias("i"), F.get(s, at)["w"].alias("w")))
        return F.transform(F.slice(F.sort_array(let(borders, run)), 1, n), lambda r: r["w"])

    placed = lambda ws: F.sort_array(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return let(words, lambda ws: F.when(F.size(ws) > 0, let(placed(ws), ranked)).otherwise(F.array().cast("array<string>")))


def topics_of(df: DataFrame, key: str, text: str, stopwords: tuple[str, ...] = STOPWORDS, n: int = MAX_TOPICS) -> DataFrame:
    """key, topics of every key; those without topics, and the null key, get an empty array.

    A row's words are counted within the row, so a task holds one text's words at a time and
    nothing but keys is shuffled.  Only the words of keys that several rows share are counted by an aggregate.
    """
    none = F.array().cast("array<string>")
    repeated = df.groupBy(key).agg(F.count("*").alias("_rows")).filter("_rows > 1").select(F.col(key).alias("_key"))
    of_rows = lambda rows: rows.select(key, F.when(F.col(key).isNotNull(), top_words(topic_words(F.col(text), stopwords), n)).otherwise(none).alias("topics")).withColumn("topics", F.coalesce("topics", none))
    if repeated.isEmpty():
        return of_rows(df)
    same = df[key].eqNullSafe(repeated["_key"])
    words = df.join(repeated, same, "left_semi").select(key, F.posexplode(topic_words(F.col(text), stopwords)).alias("pos", "word"))
    counted = words.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))).filter(F.col("rank") <= n)
    lists = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("topics"))
    shared = repeated.withColumnRenamed("_key", key).join(lists, key, "left").withColumn("topics", F.coalesce("topics", none))
    return of_rows(df.join(repeated, same, "left_anti")).unionByName(shared)


def classify_by_rules(df: DataFrame, text: str = "content") -> DataFrame:
    """Adds intent, intent_confidence, topics, is_question, is_command; social messages get no topics."""
    rule = rule_intent(F.col(text))
    topics = F.when(F.col("_rule.intent") == "social", F.array().cast("array<string>")).otherwise(top_words(topic_words(F.col(text))))
    found = df.withColumn("_rule", rule).withColumns({"intent": F.col("_rule.intent"), "intent_confidence": F.col("_rule.confidence"), "topics": topics})
    return with_flags(found.drop("_rule"))


def unclassified(df: DataFrame) -> DataFrame:
    """The columns of a run without a classifier."""
    return with_flags(df.withColumns({"intent": F.lit("unknown"), "intent_confidence": F.lit(0.0), "topics": F.array().cast("array<string>")}))


#: A zero-shot model: texts and candidate labels in, per text the labels and scores by falling score out.
ZeroShot = Callable[[list[str], list[str], str], list[tuple[list[str], list[float]]]]


def classify_zero_shot(df: DataFrame, load: Callable[[], ZeroShot], text: str = "content") -> DataFrame:
    """Adds what a zero-shot model says; load() runs once per Python worker. Blank texts are social at 0.5."""
    labels = list(ZERO_SHOT_LABELS)

    @F.pandas_udf("intent string, confidence double, labels array<string>, scores array<double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            texts = texts.fillna("")
            full = [t for t in texts if t.strip()]
            found = iter(model([t[:CLASSIFIER_CHARS] for t in full], labels, HYPOTHESIS) if full else [])
            out = []
            for t in texts:
                if not t.strip():
                    out.append(("social", 0.5, None, None))
                else:
                    names, scores = next(found)
                    out.append((ZERO_SHOT_LABELS.get(names[0], "social"), float(scores[0]), list(names[:3]), [float(s) for s in scores[:3]]))
            yield pd.DataFrame(out, columns=["intent", "confidence", "labels", "scores"])

    topics = F.when(is_blank(F.col(text)), F.array().cast("array<string>")).otherwise(top_words(topic_words(F.col(text), SHORT_STOPWORDS)))
    found = df.withColumn("_said", predict(F.col(text))).withColumns({"intent": F.col("_said.intent"), "intent_confidence": F.col("_said.confidence"), "topics": topics, "raw_prediction": F.struct("_said.labels", "_said.scores")})
    return with_flags(found.drop("_said"))


def keyword_zero_shot(texts: list[str], labels: list[str], hypothesis: str) -> list[tuple[list[str], list[float]]]:
    """A stand-in model without weights: a label scores by the words it shares with the text, ties in label order."""
    out = []
    for text in texts:
        words = set(text.lower().split())
        raw = [1 + len(words & set(hypothesis.format(label).lower().strip(".").split())) for label in labels]
        order = sorted(range(len(labels)), key=lambda k: (-raw[k], k))
        out.append(([labels[k] for k in order], [raw[k] / sum(raw) for k in order]))
    return out


def classify_from_refiner(df: DataFrame) -> DataFrame:
    """Where no classifier ran, takes intent, confidence and up to ten entities from the refiner's struct `refined`."""
    use = (F.col("intent") == "unknown") & F.col("refined.intent").isNotNull()
    found = df.withColumns({
        "topics": F.when(use, F.slice("refined.entities", 1, 10)).otherwise(F.col("topics")),
        "intent_confidence": F.when(use, F.col("refined.confidence")).otherwise(F.col("intent_confidence")),
        "intent": F.when(use, F.col("refined.intent")).otherwise(F.col("intent")),
    })
    return with_flags(found)
