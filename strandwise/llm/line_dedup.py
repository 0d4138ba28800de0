"""Line deduplication by a log-template tree, in DataFrame functions only.

The tree has a fixed depth. Its first level is a line's count of words, the next ones its leading words, with
words that hold a digit generalised to ``<*>``; a leaf holds the templates of its lines. A group of lines, at first a
whole leaf, generalises further when nearly all of them agree at nearly all places: the places where they differ
become ``<*>``. A group that does not agree is parted by the word at its most agreed place, and those that do not
follow their group's template are a group of their own, LEVELS times; so a leaf holds several templates, and what
else is in it does not decide on a family of lines.
Templates met in several documents are boilerplate: their first line stays and all others are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, SALTS, by_hot_key, fresh_name, release, staged

#: Documents in which a template must occur to be recurring.
MIN_DOCUMENTS = 2
#: and, where lines only agree at most places, documents in which they must: two alone do not tell which places vary.
WIDER_DOCUMENTS = 3
#: Leading words that lead to a leaf.
DEPTH = 3
#: A leaf generalises when lines have this many words at least,
MIN_WORDS = 6
#: and this share of places is constant,
SIMILARITY = 0.8
#: which means that this share of the group's lines has the same word there.
AGREEMENT = 0.8
#: Groups within groups of a leaf.
LEVELS = 4
WILD = "<*>"
_VARIABLE = "(?<![^ \\t-\\r])[^ \\t-\\r0-9]*+[0-9][^ \\t-\\r]*+"
_GAPS = "[ \\t\\x0B-\\r]+"
_SOLID = "[^ \\t\\x0B-\\r]"


def generalised(text: Column) -> Column:
    """A text whose words with digits are wildcards; line ends are kept, other white space is one space."""
    whole = F.coalesce(text, F.lit(""))
    masked = F.when(whole.rlike("[0-9]"), F.regexp_replace(whole, _VARIABLE, WILD)).otherwise(whole)
    odd = whole.contains("  ") | whole.contains("\t") | whole.contains("\x0b") | whole.contains("\x0c") | whole.contains("\r")
    return F.when(odd, F.regexp_replace(masked, _GAPS, " ")).otherwise(masked)


def _words(template: Column) -> Column:
    """Words of a template that is not empty: one more than it has spaces."""
    return F.octet_length(template) - F.octet_length(F.replace(template, F.lit(" "), F.lit(""))) + 1


def _leaf(template: Column) -> Column:
    return F.xxhash64(_words(template), F.substring_index(template, " ", DEPTH))


def _key(template: Column) -> Column:
    return F.unhex(F.md5(template))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, copies: bool = True) -> DataFrame:
    """All rows and columns of ``docs``; the text lacks lines whose template recurs, and two counts come along.

    A line is what lies between line feeds; blank lines are never dropped and do not count. Of a recurring
    template, the first line of the document with the smallest id stays (a null id comes last; among rows with
    one id, the smallest text hash). Two columns are added, ``__lines`` and ``__dropped`` (lines that were not
    blank, and dropped ones); underscores come before them where ``docs`` has such a column. A null text stays null and has no lines. A document keeps its row even if all its
    lines go; its text is then empty. Repeated rows with id and text count as one document and get the same
    text. An empty table gives an empty result. Without ``copies``, lines that only two documents share stay if the
    whole texts are equal: a later stage drops such copies whole. Work grows with a text's words and lines in
    proportion, however long it or a line is.
    """
    row = [F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__hash")]
    def keyed_line(line: Column) -> Column:
        template = F.trim(line)
        return F.when(template != "", F.struct(_leaf(template).alias("leaf"), _words(template).alias("words"), _key(template).alias("key")))

    scratch: list[DataFrame] = []
    parsed = staged(docs.select(*row, F.transform(F.split(generalised(F.col(text_col)), "\n"), keyed_line).alias("lines")), "line-keys", scratch)
    keyed = parsed.select("__id", "__hash", F.posexplode("lines").alias("place", "line")).where("line is not null").select("__id", "__hash", "place", "line.key")
    once = docs.select(F.explode(F.array_distinct(F.transform(F.split(generalised(F.col(text_col)), "\n"), F.trim))).alias("template")).where("template <> ''")
    met_once = parsed.select(F.xxhash64("__id", "__hash").alias("document"), "__hash", F.explode(F.array_distinct("lines")).alias("line")).where("line is not null").select("document", "__hash", "line.*")
    apart = [F.count(F.lit(1)).alias("documents"), (F.min("document") != F.max("document")).alias("several"), (F.min("__hash") != F.max("__hash")).alias("differ")]
    met_twice = (F.col("documents") >= min_documents) & F.col("several") & (F.lit(copies) | F.col("differ") | (F.col("documents") > 2))
    counted = met_once.groupBy("leaf", "words", "key").agg(*apart).select("leaf", "words", "key", "documents", met_twice.alias("recurs"))
    counted = staged(counted.where(f"recurs or words >= {MIN_WORDS}"), "line-templates", scratch)
    recurring = counted.where("recurs").select("key", F.col("key").alias("template_key"))
    merged = _merged(once, counted, max(min_documents, WIDER_DOCUMENTS), scratch)
    if merged is not None:
        recurring = recurring.join(merged.select("key", F.col("merged").alias("wider")), "key", "full").select("key", F.coalesce("wider", "template_key").alias("template_key"))

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    dealt = F.pmod(F.xxhash64("__id", "__hash"), F.lit(SALTS)).cast("int").alias("salt")
    met = staged(keyed.select("*", dealt).join(recurring.select("*", salts).hint("merge"), ["key", "salt"]).select("__id", "__hash", "place", "template_key"), "line-met")
    release(scratch)
    first = met.groupBy("template_key").agg(F.min("__id").alias("first_id"))
    start = met.groupBy("template_key", "__id", "__hash").agg(F.min("place").alias("place")).join(first.withColumnRenamed("template_key", "k"), (F.col("template_key") == F.col("k")) & (F.col("__id") == F.col("first_id")))
    start = start.groupBy("template_key", "__id").agg(F.min("__hash").alias("__hash"), F.min_by("place", "__hash").alias("place")).select("__id", "__hash", "place", "template_key", F.lit(True).alias("stays"))
    drop = met.join(start, ["__id", "__hash", "place", "template_key"], "left").where("stays is null")
    drop = drop.groupBy("__id", "__hash").agg(F.collect_set("place").alias("__places"))

    others = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col])
    marked = docs.select(others.alias("others"), F.split(F.col(text_col), "\n").alias("lines"), *row)
    marked = marked.join(drop.select(F.col("__id").alias("__id2"), F.col("__hash").alias("__hash2"), "__places").hint("merge"), (F.col("__id") == F.col("__id2")) & (F.col("__hash") == F.col("__hash2")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("__places"))
    text = F.when(F.col("__places").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at("lines", i + 1)), "\n"))
    count = F.coalesce(F.size(F.filter("lines", lambda line: line.rlike(_SOLID))), F.lit(0))
    count = F.when(F.col("lines").isNull(), 0).otherwise(count)
    dropped = F.when(F.col("__places").isNull(), 0).otherwise(F.size("__places"))
    kept = [text.alias(c) if c == text_col else F.col(f"others.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return marked.select(*kept, count.alias(fresh_name("__lines", docs.columns)), dropped.alias(fresh_name("__dropped", docs.columns)))


def _merged(once: DataFrame, counted: DataFrame, min_documents: int, scratch: list[DataFrame]) -> DataFrame | None:
    """(key, merged): templates that follow a wider template, if any leaf has such a one."""
    leaves = counted.where(f"words >= {MIN_WORDS}").groupBy("leaf").agg(F.count(F.lit(1)).alias("templates"), F.sum("documents").alias("documents"))
    leaves = staged(leaves.where(f"templates > 1 and documents >= {min_documents}").select(F.col("leaf").alias("node")), "line-leaves", scratch)
    several = leaves.count()
    if not several:
        return None
    chosen = F.broadcast(leaves) if several <= BROADCAST_ROWS else leaves
    lines = once.where(_words(F.col("template")) >= MIN_WORDS).select(_leaf(F.col("template")).alias("node"), "template").join(chosen, "node")
    lines = lines.groupBy("node", "template").agg(F.count(F.lit(1)).alias("documents"))
    lines = staged(lines.select("node", _key(F.col("template")).alias("key"), F.split("template", " ").alias("words"), "documents"), "line-leaf-templates", scratch)
    found = None
    for _ in range(LEVELS):
        follows = F.col("settled") & F.forall("form", lambda e: F.element_at("words", e["place"] + 1) == e["word"])
        rows = staged(by_hot_key(lines, staged(_forms(lines), "line-forms", scratch), "node", "templates", F.col("key")).withColumn("follows", follows), "line-groups", scratch)
        own = rows.where("follows").select("node", "key", "documents")
        found = own if found is None else found.unionByName(own)
        place = F.col("split.place")
        part = F.when(F.col("settled"), F.xxhash64("node", F.lit("rest"))).otherwise(F.xxhash64("node", place, F.element_at("words", place + 1)))
        rest = rows.where("not follows and (settled or split is not null)").select(part.alias("node"), "key", "words", "documents")
        live = rest.groupBy("node").agg(F.count(F.lit(1)).alias("templates"), F.sum("documents").alias("total")).where(f"templates > 1 and total >= {min_documents}")
        lines = staged(by_hot_key(rest, staged(live.drop("total"), "line-live", scratch), "node", "templates", F.col("key")).drop("templates"), "line-parts", scratch)
        if not lines.limit(1).count():
            break
    enough = found.groupBy("node").agg(F.count(F.lit(1)).alias("templates"), F.sum("documents").alias("met")).where(f"met >= {min_documents}")
    fit = by_hot_key(found.select("node", "key"), staged(enough, "line-enough", scratch), "node", "templates", F.col("key"))
    return fit.select("key", F.unhex(F.md5(F.concat(F.lit("leaf:"), F.col("node").cast("string")))).alias("merged"))


def _forms(lines: DataFrame) -> DataFrame:
    """(node, templates, settled, form, split): of each group the places with an agreed word, whether they are enough, and where to part it."""
    whole = lines.groupBy("node").agg(F.sum("documents").alias("total"), F.count(F.lit(1)).alias("templates"), F.max(F.size("words")).alias("width"))
    votes = lines.select("node", "documents", F.posexplode("words").alias("place", "word")).where(f"word <> '{WILD}'").groupBy("node", "place", "word").agg(F.sum("documents").alias("votes"))
    best = votes.groupBy("node", "place").agg(F.max(F.struct("votes", "word")).alias("top")).join(whole, "node")
    agreed = F.col("top.votes") >= AGREEMENT * F.col("total")
    form = F.collect_list(F.when(agreed, F.struct("place", F.col("top.word").alias("word"))))
    split = F.max(F.when(F.col("top.votes") < F.col("total"), F.struct(F.col("top.votes").alias("votes"), (-F.col("place")).alias("before"), F.col("place").alias("place"))))
    tree = best.groupBy("node", "templates", "width").agg(form.alias("form"), split.alias("split"))
    return tree.select("node", "templates", (F.size("form") >= SIMILARITY * F.col("width")).alias("settled"), "form", "split")
