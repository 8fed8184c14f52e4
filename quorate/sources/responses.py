"""Normalising per-model responses of scoring services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.sources.signatures import read_lines

# Accepted key names and label synonyms, in order of preference.
RESULT_KEYS = ["ModelResults", "model_results", "models", "Models", "SubModels", "sub_models", "model_scores", "ModelScores",
               "Scores", "scores", "details", "Details"]
PROBABILITY_KEYS = ["probability", "malware_probability", "malicious_probability", "malware_prob", "malicious_prob", "score",
                    "Score", "confidence", "Confidence", "prob"]
BENIGN_PROBABILITY_KEYS = ["benign_probability", "benign_prob"]
FLAG_KEYS = ["is_malware", "isMalware", "IsMalware", "malicious", "is_malicious"]
LABEL_KEYS = ["label", "Label", "result", "Result", "verdict", "Verdict", "Status"]
NAME_KEYS = ["model", "model_name", "Model", "ModelName", "name", "engine_name"]
MALICIOUS_WORDS = ["malware", "malicious", "virus", "detected", "infected", "bad"]
BENIGN_WORDS = ["benign", "safe", "clean", "undetected", "normal", "good"]


def first_key(json: Column, keys: list[str]) -> Column:
    """Value of the first key present in a JSON object, as text."""
    return F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in keys])


def first_keys(df: DataFrame, json: str, keys: dict[str, list[str]]) -> DataFrame:
    """Add a column per name with the value of the first of its keys, as text; every text is parsed once for all of them."""
    places = {k: f"__k{i}" for i, k in enumerate(dict.fromkeys(k for own in keys.values() for k in own))}
    parsed = df.select(*df.columns, F.json_tuple(json, *places).alias(*places.values()))
    return parsed.select(*df.columns, *[F.coalesce(*[F.col(places[k]) for k in own]).alias(name) for name, own in keys.items()])


def normalise_probability(text: Column) -> Column:
    """Text to a probability: percent signs, values above one as percent, clamped to [0, 1], NULL if unreadable."""
    t = F.trim(text.cast("string"))
    percent = t.endswith("%")
    number = F.when(percent, F.regexp_replace(t, "%$", "")).otherwise(t).try_cast("double")
    value = F.when(percent | (number > 1), number / 100).otherwise(number)
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def probability_of(probability: Column, benign: Column, label: Column) -> Column:
    """Probability from the texts of any known key; a lone benign probability counts when the label says benign."""
    direct, benign, label = normalise_probability(probability), normalise_probability(benign), F.lower(label)
    return F.coalesce(direct, F.when(label.isin("benign", "safe", "clean"), F.lit(1.0) - benign))


def normalise_verdict(flag: Column, label: Column, probability: Column, thr: float = 0.5) -> Column:
    """malicious / benign / failed: an explicit flag first, then label synonyms, then the threshold."""
    word = F.lower(F.trim(label))
    return (F.when(F.lower(flag) == "true", "malicious").when(F.lower(flag) == "false", "benign")
            .when(word.isin(MALICIOUS_WORDS), "malicious").when(word.isin(BENIGN_WORDS), "benign")
            .when(probability.isNull(), "failed").when(probability > thr, "malicious").otherwise("benign"))


def model_items(df: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """One row (name, item) per model: the results may be an object, a list or scalars."""
    body = F.col("__results")
    base = first_keys(df.select(*keep, json), json, {"__results": RESULT_KEYS}).select(*keep, F.coalesce(body, F.lit("{}")).alias("__body"), body.isNull().alias("__none"), F.col(json).alias("__root"))
    as_map = F.from_json("__body", "map<string,string>")
    as_list = F.from_json("__body", "array<string>")
    named = F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("item")))
    listed = F.transform(as_list, lambda v, i: F.struct(F.coalesce(
        F.when(v.startswith("{"), first_key(v, NAME_KEYS)), F.concat(F.lit("Model-"), (i + 1).cast("string"))).alias("name"), v.alias("item")))
    whole = F.array(F.struct(F.lit("ensemble").alias("name"), F.col("__root").alias("item")))
    items = F.when(F.col("__none"), whole).when(F.col("__body").startswith("["), listed).otherwise(named)
    rows = base.select(*keep, F.inline(items))
    return rows.withColumn("item", F.when(F.col("item").startswith("{"), F.col("item")).otherwise(
        F.to_json(F.struct(F.col("item").alias("probability")))))


def normalise(df: DataFrame, json: str, keep: list[str], thr: float = 0.5) -> DataFrame:
    parts = {"__probability": PROBABILITY_KEYS, "__benign": BENIGN_PROBABILITY_KEYS, "__word": LABEL_KEYS[:-1], "__flag": FLAG_KEYS, "__label": LABEL_KEYS}
    rows = first_keys(model_items(df, json, keep), "item", parts) \
        .withColumn("probability", F.round(probability_of(F.col("__probability"), F.col("__benign"), F.col("__word")), 4))
    return rows.select(*keep, "name", "probability", normalise_verdict(F.col("__flag"), F.col("__label"), F.col("probability"), thr).alias("result"))


def read_model_responses(spark: SparkSession, path: str) -> DataFrame:
    return normalise(read_lines(spark, path), "value", ["row_id"])
