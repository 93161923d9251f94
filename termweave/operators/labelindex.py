"""Token search (L03-L05) over a written index of labels, kept up to date by what changed.

An index is a folder of three tables, each in folders by the hash of what it is looked up by: `postings`
(a word and the labels that hold it), `grams` (one to three characters and the words that hold them) and
`names` (local names).  A search reads the folders that its tokens fall into, an update rewrites those
that hold words or names of changed entities.  The driver learns folder numbers only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.model import Ontology, local_name
from termweave.operators.search import best_of, met_by, query_tokens, search_text
from termweave.plans.tables import save

#: Columns of each table but its folder; the first is what it is looked up by.
COLUMNS = {
    "postings": "word string, onto_id string, iri string, text string, size double",
    "grams": "gram string, word string",
    "names": "q string, onto_id string, iri string",
}
#: Characters of the longest piece of a word that is a key.
GRAM = 3


@dataclass(frozen=True)
class LabelIndex:
    """A written index; `folders` is its number of folders a table, the same in every use."""

    spark: SparkSession
    path: str
    folders: int = 64

    def of(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.folders)).cast("int")

    def numbers(self, keys: DataFrame) -> list[int]:
        """The folders of a table of one column of keys: at most `folders` numbers."""
        return [r[0] for r in keys.select(self.of(keys.columns[0]).alias("part")).distinct().collect()]

    def read(self, name: str, numbers: list[int] | None = None) -> DataFrame:
        d = self.spark.read.schema(COLUMNS[name] + ", part int").parquet(f"{self.path}/{name}")
        return d if numbers is None else d.where(F.col("part").isin(numbers))

    def write(self, name: str, rows: DataFrame, mode: str) -> None:
        """Rows in folders, sorted by key; `overwrite` replaces the folders that rows fall into and no others."""
        key, spread = COLUMNS[name].split()[0], F.xxhash64(*rows.columns)
        # one word may be in most labels: ranges split its rows, so its folder is written by several tasks
        laid = rows.repartitionByRange("part", key, spread).sortWithinPartitions("part", key)
        laid.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{name}")


def postings(x: Ontology) -> DataFrame:
    """word, onto_id, iri, text, size: every word of every search text, with the mean length of its entity's texts."""
    texts = search_text(x)
    size = texts.groupBy("onto_id", "iri").agg(F.avg(F.length("text")).alias("size"))
    words = texts.select("onto_id", "iri", "text", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    return words.where("word <> ''").join(size, ["onto_id", "iri"]).select("word", "onto_id", "iri", "text", "size").distinct()


def names(x: Ontology) -> DataFrame:
    return x.entity.select(F.lower(local_name(F.col("iri"))).alias("q"), "onto_id", "iri").distinct()


def pieces(c: str, n: int) -> Column:
    """The distinct parts of n characters of a column."""
    starts = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(F.col(c), i, F.lit(n))))


def grams(words: DataFrame) -> DataFrame:
    """gram, word: every part of one to GRAM characters of distinct words."""
    return words.select(F.explode(F.flatten(F.array(*(pieces("word", n) for n in range(1, GRAM + 1))))).alias("gram"), "word")


def marks(index: LabelIndex, name: str, numbers: DataFrame) -> DataFrame:
    """A row of nulls for each folder: one that lost all its rows is replaced too."""
    cols = [c.split() for c in COLUMNS[name].split(", ")]
    return numbers.select(*(F.lit(None).cast(t).alias(c) for c, t in cols), "part")


def build(x: Ontology, index: LabelIndex) -> LabelIndex:
    """Write the index of an ontology's labels, SKOS labels and local names to index.path, which holds none yet."""
    every = index.spark.range(index.folders).select(F.col("id").cast("int").alias("part"))
    post = save(postings(x), "postings")
    for name, rows in (("postings", post), ("grams", grams(post.select("word").distinct())), ("names", names(x))):
        key = rows.columns[0]
        index.write(name, rows.withColumn("part", index.of(key)).unionByName(marks(index, name, every)), "errorifexists")
    return index


def update(index: LabelIndex, old: Ontology, new: Ontology, touched: DataFrame) -> LabelIndex:
    """Bring the index of old to that of new, which differ in the entities touched (onto_id, iri) only.

    Rows of touched entities leave the folders of their old and new words and names; the new ones enter.
    An update that was cut short may be run again.  Words that no label holds any more stay keys of
    `grams`, where they lead to nothing.
    """
    k = ["onto_id", "iri"]
    t = save(touched.select(*k).distinct(), "touched")
    on = lambda d, how: d.join(t.select(F.col("onto_id").alias("_o"), F.col("iri").alias("_i")), F.col("onto_id").eqNullSafe(F.col("_o")) & F.col("iri").eqNullSafe(F.col("_i")), how)

    def part_of(x: Ontology) -> Ontology:
        return replace(x, **{n: on(getattr(x, n), "left_semi") for n in ("entity", "label", "annotation")})

    before, after = part_of(old), part_of(new)
    for name, rows in (("postings", postings), ("names", names)):
        was, now = rows(before), save(rows(after), "delta")
        key = now.columns[0]
        numbers = save(was.select(key).unionByName(now.select(key)).select(index.of(key).alias("part")).distinct(), "folders")
        found = [r[0] for r in numbers.collect()]  # at most `folders` numbers
        stay = on(index.read(name, found).where(F.col(key).isNotNull()), "left_anti")
        if name == "postings":
            fresh = save(grams(now.select("word").distinct()), "grams")
            known = index.read("grams", index.numbers(fresh.select("gram"))).select("gram", "word")
            lacking = save(fresh.join(known, ["gram", "word"], "left_anti").withColumn("part", index.of("gram")), "lacking")
            index.write("grams", lacking, "append")
        rewritten = stay.unionByName(now.withColumn("part", index.of(key))).unionByName(marks(index, name, numbers))
        index.write(name, save(rewritten, "rewritten"), "overwrite")
    return index


def words_holding(index: LabelIndex, tokens: DataFrame) -> DataFrame:
    """word, token: the index's words that tokens are part of, looked up by each token's rarest piece."""
    wanted = F.when(F.length("token") <= GRAM, F.array("token")).otherwise(pieces("token", GRAM))
    asked = save(tokens.select("token", F.explode(wanted).alias("gram")), "asked")
    known = index.read("grams", index.numbers(asked.select("gram"))).select("gram", "word").join(asked.select("gram").distinct(), "gram", "left_semi")
    often = known.groupBy("gram").agg(F.count("*").alias("n"))
    per = asked.join(often, "gram", "left").groupBy("token").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram"))["gram"].alias("gram"))
    return known.join(per, "gram").where(F.contains("word", "token")).select("word", "token").distinct()


def search(index: LabelIndex, queries: DataFrame, k: int = 50) -> DataFrame:
    """query_id, rank, iri, score of a table (query_id, query), as `operators.search.search` gives them."""
    q = query_tokens(queries).withColumn("want", F.array_distinct("tokens"))
    hits = save(words_holding(index, q.select(F.explode("want").alias("token")).distinct()), "hits")
    post = index.read("postings", index.numbers(hits.select("word"))).join(hits, "word")
    labels = post.groupBy("onto_id", "iri", "text", "size").agg(F.collect_set("token").alias("held"))
    entity = save(labels.groupBy("onto_id", "iri", "size").agg(F.collect_list(F.struct("text", "held")).alias("labels"), F.array_distinct(F.flatten(F.collect_list("held"))).alias("held")), "held")
    scored = met_by(q, entity).select("onto_id", "query_id", "iri", F.coalesce("score", 1 - F.col("size") * 0.001).alias("score"))
    return best_of(scored, index.read("names", index.numbers(q.select("q"))), q, k)
