"""Term weights and token likeness, with dictionaries as optional lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Factors of entity and word classes.
ENTITY = {"toxic": 2.0, "func": 1.0, "corp": 3.0, "loca": 3.0, "sch": 3.0, "stock": 3.0, "firstnm": 1.0}
CLASS = {"r": 0.3, "c": 0.3, "d": 0.3, "ns": 3.0, "nt": 3.0, "n": 2.0}


def _factor(name: Column, of: dict[str, float], otherwise: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.coalesce(name, F.lit(""))), otherwise)


def frequency(token: Column, known: Column) -> Column:
    """How often a token counts as used: numbers 3, unknown Latin 300, else the dictionary's, at least 10."""
    return F.when(token.rlike(r"^[0-9. -]{2,}$"), F.lit(3.0)).when((F.coalesce(known, F.lit(0.0)) == 0) & token.rlike("^[a-z. -]+$"), F.lit(300.0)).otherwise(F.greatest(F.coalesce(known, F.lit(0.0)), F.lit(10.0)))


def document_frequency(token: Column, known: Column) -> Column:
    return F.when(token.rlike(r"^[0-9. -]{2,}$"), F.lit(5.0)).when(known.isNotNull(), known + 3.0).when(token.rlike("^[a-z. -]+$"), F.lit(300.0)).otherwise(F.lit(3.0))


def rarity(s: Column, n: float) -> Column:
    return F.log10(10.0 + (n - s + 0.5) / (s + 0.5))


def raw_weight(token: Column, freq: Column | None = None, df: Column | None = None, entity: Column | None = None, word_class: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    freq, df = freq if freq is not None else none, df if df is not None else none
    entity, word_class = entity if entity is not None else F.lit(None), word_class if word_class is not None else F.lit(None)
    named = F.when(token.rlike("^[0-9,.]{2,}$"), F.lit(2.0)).when(token.rlike("^[a-z]{1,2}$"), F.lit(0.01)).otherwise(_factor(entity.cast("string"), ENTITY, F.lit(1.0)))
    tagged = _factor(word_class.cast("string"), CLASS, F.when(token.rlike("^[0-9-]+"), F.lit(2.0)).otherwise(F.lit(1.0)))
    return (0.3 * rarity(frequency(token, freq), 1e7) + 0.7 * rarity(document_frequency(token, df), 1e9)) * named * tagged


def weighted_tokens(tokens: DataFrame, key: str, dictionary: DataFrame | None = None) -> DataFrame:
    """key, token, weight: weights of a text's distinct tokens, adding up to 1. tokens: a row for each token.

    dictionary: token, freq, df, entity, word_class, joined by token.
    """
    rows = tokens if dictionary is None else tokens.join(dictionary, "token", "left")
    extra = {c: F.col(c) for c in ("freq", "df", "entity", "word_class")} if dictionary is not None else {}
    raw = rows.withColumn("w", raw_weight(F.col("token"), **extra)).groupBy(key, "token").agg(F.sum("w").alias("w"))
    return raw.select(key, "token", (F.col("w") / F.sum("w").over(W.partitionBy(key))).alias("weight"))


def synonyms(tokens: DataFrame, token: str, dictionary: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Adds synonyms: of Latin words their other lemmas, of the rest what a dictionary lists. Both lookups are tables: name, others."""
    key = F.when(F.col(token).rlike("^[a-z]+$"), F.col(token)).otherwise(F.regexp_replace(F.lower(token), r"[ \t]+", " "))
    both = lemmas.select("name", "others", F.lit(True).alias("_latin")).unionByName(dictionary.select("name", "others", F.lit(False).alias("_latin")))
    both = both.select(F.explode("others").alias("_o"), "name", "_latin").groupBy("name", "_latin").agg(F.array_sort(F.collect_set("_o")).alias("_others"))
    marked = tokens.withColumns({"_key": key, "_is": F.col(token).rlike("^[a-z]+$")})
    found = marked.join(both, (F.col("_key") == F.col("name")) & (F.col("_is") == F.col("_latin")), "left")
    plain = F.array_distinct(F.transform("_others", lambda o: F.when(F.col("_is"), F.replace(o, F.lit("_"), F.lit(" "))).otherwise(o)))
    kept = F.filter(F.coalesce(plain, F.array().cast("array<string>")), lambda o: (o != "") & (~F.col("_is") | (o != F.col(token))))
    return found.withColumn("synonyms", kept).drop("_key", "_is", "name", "_latin", "_others")


def token_likeness(query: DataFrame, doc: DataFrame, pairs: DataFrame, query_key: str, key: str) -> DataFrame:
    """query_key, key, likeness: the query's weight on tokens that the document has. pairs says which to compare.

    query: (query_key, token, weight); doc: (key, token) distinct.
    """
    whole = query.groupBy(query_key).agg(F.sum("weight").alias("_all"))
    shared = pairs.select(query_key, key).join(query, query_key).join(doc.select(key, "token"), [key, "token"]).groupBy(query_key, key).agg(F.sum("weight").alias("_s"))
    out = pairs.select(query_key, key).join(whole, query_key, "left").join(shared, [query_key, key], "left")
    zero = F.lit(0.0)
    return out.select(query_key, key, ((F.coalesce("_s", zero) + 1e-9) / (F.coalesce("_all", zero) + 1e-9)).alias("likeness"))


def clauses(weighted: DataFrame, key: str, order: str) -> DataFrame:
    """key, clause, weight: every token, and each two neighbours as a phrase of twice the higher weight.

    weighted: key, order, token, weight.
    """
    w = W.partitionBy(key).orderBy(order)
    nxt = weighted.withColumns({"_t": F.lead("token").over(w), "_w": F.lead("weight").over(w)})
    phrase = F.when(F.col("_t").isNotNull(), F.struct(F.concat("token", F.lit(" "), "_t").alias("clause"), (2 * F.greatest("weight", "_w")).alias("weight")))
    both = F.array_compact(F.array(F.struct(F.col("token").alias("clause"), F.col("weight").alias("weight")), phrase))
    return nxt.select(key, F.explode(both).alias("c")).select(key, "c.clause", "c.weight")
