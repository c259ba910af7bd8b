"""Mixing sources to target weights: hash-random order within each source, cut at the source's budget of words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchpath.llm.common import WORD, fresh, n_words
from touchpath.llm.prefix import running_total, uniform_key
from touchpath.session import cut_lineage

_GROUP = ["_unnamed", "_source"]
#: A repeated row is written again in two steps of at most this many copies each.
_COPIES = 100_000
#: Rows that may be sent to every task.
_BROADCAST_ROWS = 10_000


@dataclass(frozen=True)
class MixOptions:
    """Sources in code-point order (null last) weigh ``weights``, repeating; together they give ``share`` of all words.

    No source gives more than ``epochs`` times its own words.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    epochs: int = 2


OPTIONS = MixOptions()


def _sized(docs: DataFrame) -> DataFrame:
    """Distinct (source, doc_id, size) with the number of such rows, stored: all that the mix needs of the texts."""
    slim = docs.select(
        F.col("source").isNull().alias("_unnamed"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        F.col("doc_id").cast("long").alias("doc_id"), n_words(F.col("text").cast("string")).alias("size"),
    )
    rows = slim.groupBy(*_GROUP, "doc_id", "size").agg(F.count("*").alias("rows"))
    rows = rows.withColumn("words", F.col("rows") * F.col("size")).withColumn("key", uniform_key(F.col("doc_id"), F.col("size")))
    return cut_lineage(rows)


def source_targets(sized: DataFrame, options: MixOptions = OPTIONS) -> DataFrame:
    """One row per source: ``source_size``, ``n`` and ``target``.

    Water-filling in closed form: by ascending cap per weight, a source is capped if all sources up to it at their caps
    and the rest at its level need no more than the whole budget; the others share what is left by weight. The totals of
    all sources, one row each, are ordered in one task: sources are corpora, not sites.
    """
    totals = sized.groupBy(*_GROUP).agg(F.sum("words").alias("source_size"), F.count("*").alias("n"))
    by_name = Window.orderBy(*_GROUP)  # one row per source
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in options.weights)), ((F.row_number().over(by_name) - 1) % len(options.weights) + 1).cast("int"))
    cap = (F.lit(options.epochs) * F.col("source_size")).cast("double")
    all_rows = Window.partitionBy()
    levels = totals.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("level", *_GROUP).rowsBetween(Window.unboundedPreceding, 0)
    levels = (
        levels.withColumn("budget", F.lit(options.share) * F.sum("source_size").over(all_rows))
        .withColumn("need", F.sum("cap").over(upto) + F.col("level") * (F.sum("weight").over(all_rows) - F.sum("weight").over(upto)))
        .withColumn("capped", F.col("need") <= F.col("budget"))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(all_rows), F.lit(0.0)))
        .withColumn("open", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(all_rows))
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("left") / F.col("open") * F.col("weight")))
    return levels.select(*_GROUP, "source_size", "n", target.alias("target"))


def _taken(docs: DataFrame, options: MixOptions) -> DataFrame:
    """``_sized`` rows with ``target``, ``source_size``, whole ``epochs`` and the ``rest`` of the budget left before them."""
    sized = _sized(docs)
    targets = cut_lineage(source_targets(sized, options))
    placed = running_total(sized, targets.select(*_GROUP, "n"), _GROUP, "key", ["doc_id", "size"], "words", "before")
    budget = F.floor("target").cast("long")
    return (
        placed.join(targets.drop("n"), _GROUP)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long")))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size") - F.col("before"))
    )


def mix(docs: DataFrame, options: MixOptions = OPTIONS) -> DataFrame:
    """What the mix takes of each row of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``.

    Reads ``doc_id``, ``source`` and ``text``. ``size`` counts words (null text: 0) and ``taken`` the words taken, repeats
    included; a source's ``taken`` add up to its target rounded down: whole epochs of it, then one partial pass in
    hash order that ends inside the document where the budget ends. The order depends on (``doc_id``, ``size``)
    alone, so reruns agree. A null source is a source of its own and comes last; null ids are ids like any other;
    repeated rows follow each other and take part one by one; sources without words take nothing; an empty table gives
    no rows.
    """
    rows = _taken(docs, options)
    copies = F.expr(f"explode(sequence(0L, (rows - 1) div {_COPIES}))").alias("_lot")
    rows = rows.select("*", copies)
    rows = rows.select("*", F.expr(f"explode(sequence(_lot * {_COPIES}, least(rows, (_lot + 1) * {_COPIES}) - 1))").alias("_copy"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_copy") * F.col("size")))
    return rows.select(
        "doc_id", F.when(~F.col("_unnamed"), F.col("_source")).alias("source"), "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
    )


def mix_documents(docs: DataFrame, options: MixOptions = OPTIONS) -> DataFrame:
    """The mix itself: ``docs`` with all their columns, each row once per epoch that takes it.

    The row in which a source's budget ends comes with its first words only; ``n_chars``, if there is one, then follows
    the text. Of rows equal in source, id and size the last pass takes one after the other, as ``mix`` says. Rows without
    a word are not in the mix. Other cases as in ``mix``.

    Only the rows among which a budget ends, one group of equal rows of a source at most, are numbered; they are stored first.
    """
    names = ["unnamed", "source", "id", "size", "epochs", "part", "rows", "cut", "number", "place", "take"]
    own = dict(zip(names, fresh(docs, *(f"_mix_{n}" for n in names)), strict=True))
    part = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest"))).cast("long")
    taken = _taken(docs, options).select(
        F.col("_unnamed").alias(own["unnamed"]), F.col("_source").alias(own["source"]), F.col("doc_id").alias(own["id"]),
        F.col("size").alias(own["size"]), F.col("epochs").alias(own["epochs"]), part.alias(own["part"]), F.col("rows").alias(own["rows"]),
        ((F.col("rows") > 1) & (part > 0) & (part < F.col("words"))).alias(own["cut"]),
    ).where(F.col(own["size"]) > 0)
    taken = cut_lineage(taken)
    size = F.col(own["size"])

    def met(groups: DataFrame) -> DataFrame:
        same = (
            (F.col("source").isNull() == F.col(own["unnamed"])) & (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col(own["source"]))
            & F.col("doc_id").cast("long").eqNullSafe(F.col(own["id"])) & (n_words(F.col("text").cast("string")) == size)
        )
        return docs.join(groups, same)

    def passes(rows: DataFrame, last: Column) -> DataFrame:
        takes = F.concat(F.array_repeat(size, F.col(own["epochs"]).cast("int")), F.array(last.cast("long")))
        return rows.select(*docs.columns, size, F.explode(F.filter(takes, lambda n: n > 0)).alias(own["take"]))

    whole = passes(met(taken.where(~F.col(own["cut"]))), F.expr(f"`{own['part']}` div `{own['rows']}`"))
    cut = taken.where(own["cut"])
    n_cut = cut.count()  # one a source at most
    if n_cut:
        ends = cut_lineage(met(F.broadcast(cut) if n_cut <= _BROADCAST_ROWS else cut).withColumn(own["number"], F.monotonically_increasing_id()))
        narrow = ends.select(*(F.col(own[c]).alias(f"_{c}") for c in ("unnamed", "source", "number")), F.lit(1).cast("long").alias("_one"))
        narrow = cut_lineage(narrow.withColumn("key", uniform_key(F.col("_number"))))
        counts = cut_lineage(narrow.groupBy(*_GROUP).agg(F.count("*").alias("n")))
        order = running_total(narrow, counts, _GROUP, "key", ["_number"], "_one", "_place")
        ends = ends.join(order.select(F.col("_number").alias(own["number"]), F.col("_place").alias(own["place"])), own["number"])
        last = F.greatest(F.lit(0), F.least(size, F.col(own["part"]) - F.col(own["place"]) * size))
        whole = whole.unionByName(passes(ends, last))
    take = F.col(own["take"])
    pieces = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    text = F.when(take >= size, F.col("text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), take.cast("int")), ""))
    mixed = whole.withColumn("text", text)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*docs.columns)


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), capped AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][(place - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap,
    1.5::DOUBLE * (SELECT sum(size) FROM sized) AS budget, place FROM sources
), filled AS (
  SELECT a.source, a.source_size, a.weight, a.cap, a.budget,
    (SELECT sum(CASE WHEN b.cap / b.weight <= a.cap / a.weight THEN b.cap ELSE a.cap / a.weight * b.weight END) FROM capped b) <= a.budget AS topped
  FROM capped a
), targets AS (
  SELECT source, source_size, CASE WHEN topped THEN cap ELSE least(cap,
    (budget - coalesce((SELECT sum(cap) FROM filled WHERE topped), 0.0)) / (SELECT sum(weight) FROM filled WHERE NOT topped) * weight) END AS target
  FROM filled
), placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS words,
    CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
    coalesce(sum(s.size) OVER (PARTITION BY s.source
      ORDER BY ('0x' || substr(md5(concat_ws('/', coalesce(s.doc_id::VARCHAR, ''), s.size::VARCHAR)), 1, 15))::BIGINT, s.doc_id NULLS FIRST, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size::BIGINT AS size, source_size, target,
  (epochs * size + greatest(0, least(size, words - epochs * source_size - before)))::BIGINT AS taken FROM placed
"""
