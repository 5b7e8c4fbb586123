"""Entities in sentences: dictionary matching, overlaps, linking, candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import span_of

#: The semantic types that entities must have, and the words that stand for none.
BACTERIA_TYPE = "T007"
DISEASE_TYPES = ("T019", "T020", "T033", "T037", "T046", "T047", "T048", "T049", "T184", "T190", "T191")
STOP_BACTERIA, STOP_DISEASES = ("bacteria", "bacterias", "probiotic", "probiotics"), ("disease", "diseases")
#: What the types stand for.
TYPE_NAMES = {
    "T019": "Congenital Abnormality (conditions present at birth)",
    "T020": "Acquired Abnormality (conditions developed after birth)",
    "T033": "Finding (lab results, signs & symptoms suggesting a disorder)",
    "T037": "Injury or Poisoning",
    "T046": "Pathologic Function (abnormal processes associated with disease)",
    "T047": "Disease or Syndrome (a collection of signs/symptoms)",
    "T048": "Mental or Behavioral Dysfunction (e.g., depression, autism)",
    "T049": "Cell or Molecular Dysfunction (abnormalities at a cellular level)",
    "T184": "Sign or Symptom (indications of a disease)",
    "T190": "Anatomical Abnormality (structural deviations from normal)",
    "T191": "Neoplastic Process (tumors, cancers)",
}


def type_name(kind: Column) -> Column:
    """What a type stands for; 'None' for a missing one."""
    out = F.lit(None).cast("string")
    for k, v in TYPE_NAMES.items():
        out = F.when(kind == k, v).otherwise(out)
    return F.when(kind.isNull(), "None").otherwise(out)


def dictionary_hits(sentence: Column, terms: list[str]) -> Column:
    """Terms that occur as words of a sentence, in the order of the dictionary."""
    words = F.split(F.translate(sentence, "().,;", "     "), " +", -1)
    return F.array_intersect(F.array(*[F.lit(t) for t in terms]), words)


def overlap(a: Column, b: Column) -> Column:
    """Whether two spans share a character, the last one of each left out; spans of one character never do."""
    return F.greatest(a["start"], b["start"]) < F.least(a["end"], b["end"])


def resolve_overlaps(rows: DataFrame) -> DataFrame:
    """Of (sentence, diseases, bacterias): without the shorter of each overlapping pair, the disease where they tie.

    Entities that the sentence does not contain go. Rows with an empty list afterwards go.
    """

    def located(names: str) -> Column:
        spans = F.transform(names, lambda n: F.struct(n.alias("name"), span_of(F.col("sentence"), n).alias("s")))
        return F.filter(spans, lambda x: x["s"].isNotNull())

    def size(x: Column) -> Column:
        return x["s"]["end"] - x["s"]["start"]

    both = rows.withColumn("d", located("diseases")).withColumn("b", located("bacterias"))
    d = F.filter("d", lambda x: ~F.exists("b", lambda y: overlap(x["s"], y["s"]) & (size(x) <= size(y))))
    b = F.filter("b", lambda y: ~F.exists("d", lambda x: overlap(x["s"], y["s"]) & (size(y) < size(x))))
    both = both.withColumn("diseases", F.transform(d, lambda x: x["name"])).withColumn("bacterias", F.transform(b, lambda x: x["name"]))
    return both.drop("d", "b").where((F.size("diseases") > 0) & (F.size("bacterias") > 0))


def candidate_pairs(rows: DataFrame, *keep: str) -> DataFrame:
    """Every disease with every bacteria of a sentence."""
    d = rows.select(*keep, "bacterias", F.explode("diseases").alias("disease"))
    return d.select(*keep, "disease", F.explode("bacterias").alias("bacteria"))


def no_stop_entities(pairs: DataFrame) -> DataFrame:
    return pairs.where(~F.lower("bacteria").isin(*STOP_BACTERIA) & ~F.lower("disease").isin(*STOP_DISEASES))


def accepted(kind: Column, disease: bool) -> Column:
    return kind.isin(*DISEASE_TYPES) if disease else kind == BACTERIA_TYPE


def best_candidate(mentions: DataFrame, aliases: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Each mention with its best alias row; one without any keeps nulls."""
    best = aliases.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    return mentions.join(best, key, "left")


def similar_first(candidates: DataFrame, mention: str, place: str, least: float = 0.9) -> DataFrame:
    """Of (mention, place, similarity, tui): the first candidate of each mention, if it is more similar than ``least`` and a bacterium."""
    first = candidates.withColumn("_r", F.row_number().over(Window.partitionBy(mention).orderBy(place))).where("_r = 1").drop("_r")
    return first.where((F.col("similarity") > least) & accepted(F.col("tui"), False))


def closest_candidate(rows: DataFrame, cui: str, candidate: str, distance: Column) -> DataFrame:
    """(cui, candidate): the closest of several, a single one as it is, null where there is none; ties to the smallest."""
    best = F.row_number().over(Window.partitionBy(cui).orderBy(distance.asc_nulls_last(), candidate))
    return rows.withColumn("_r", best).where("_r = 1").select(cui, candidate)


def merged_words(words: Column, predicted: Column) -> Column:
    """Distinct hits among the words: two predicted ones in a row as one, else a word by itself unless the hit before contains it; the
    last word always."""
    n = F.size(words)

    def step(hits: Column, i: Column) -> Column:
        w, after = F.get(words, i), F.get(words, i + 1)
        pair = (i < n - 1) & F.array_contains(predicted, after)
        alone = (i == n - 1) | (F.size(hits) == 0) | ~F.contains(F.element_at(hits, -1), w)
        more = F.when(pair, F.array(F.concat(w, F.lit(" "), after))).when(alone, F.array(w)).otherwise(F.array().cast("array<string>"))
        return F.concat(hits, F.when(F.array_contains(predicted, w), more).otherwise(F.array().cast("array<string>")))

    return F.array_distinct(F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<string>"), step))


def synonym_cascade(entities: DataFrame, key: str, candidates: Column, names: DataFrame) -> DataFrame:
    """(key, tax_id): that of the first candidate name which ``names`` (name, tax_id) has; null where it has none."""
    each = entities.select(key, F.posexplode(candidates).alias("priority", "name"))
    found = each.join(names, "name").groupBy(key).agg(F.min_by("tax_id", "priority").alias("tax_id"))
    return entities.select(key).join(found, key, "left")


def words_from_tokens(tokens: DataFrame) -> DataFrame:
    """Of (sentence, word, position, token, prediction): words with their tokens joined and the mean prediction rounded up."""
    each = tokens.groupBy("sentence", "word").agg(F.collect_list(F.struct("position", "token", "prediction")).alias("tokens"))
    return each.select("sentence", "word", *word_of(F.col("tokens")))


def word_of(tokens: Column) -> list[Column]:
    """``text`` and ``prediction`` of one word's tokens, an array of (position, token, prediction) in any order."""
    text = F.array_join(F.transform(F.array_sort(tokens), lambda x: x["token"]), "")
    known = F.filter(F.transform(tokens, lambda x: x["prediction"]), lambda p: p.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda s, p: s + p.cast("double"))
    return [text.alias("text"), F.when(F.size(known) > 0, F.ceil(total / F.size(known)).cast("long")).alias("prediction")]


def tag_ids(tags: DataFrame, column: str) -> DataFrame:
    """(tag, id) of all tags of a space-separated column, ids from 0 in tag order. Tag sets are small."""
    distinct = tags.select(F.explode(F.split(column, " ")).alias("tag")).distinct()
    return distinct.select("tag", (F.dense_rank().over(Window.orderBy("tag")) - 1).alias("id"))
