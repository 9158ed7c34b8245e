"""Entity resolution (rows 143-156)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from claimloom.functions import text as T
from claimloom.operators.graph import cut_lineage
from claimloom.operators.relational import top_k


def duplicate_groups(entities: DataFrame, key: Column) -> DataFrame:
    """#143, #144. Groups of two or more entities with one key and type: size, sorted ids and names."""
    g = entities.filter(key.isNotNull()).groupBy(key.alias("key"), "entity_type")
    g = g.agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("ids"))
    return g.filter("size > 1")


def name_quality(name: Column) -> Column:
    """#145. Better names are capitalised, of two or more words, and not all capitals."""
    return (name.rlike(r"^[A-Z]")).cast("int") + (F.size(F.split(F.trim(name), r"\s+")) > 1).cast("int") + (F.upper(name) != name).cast("int")


def canonical(entities: DataFrame, key: Column) -> DataFrame:
    """#145. (entity_id, canonical_id): of each key and type the entity with a QID, most mentions, best name."""
    w = Window.partitionBy("_key", "entity_type").orderBy(F.col("wikidata_qid").isNull(), F.desc("mention_count"), F.desc(name_quality(F.col("canonical_name"))), "entity_id")
    return entities.withColumn("_key", key).select("entity_id", F.first("entity_id").over(w).alias("canonical_id"))


def merge_entities(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """#146. Entities merged into their canonical one: mentions summed, names united as aliases."""
    j = entities.join(mapping, "entity_id", "left").withColumn("canonical_id", F.coalesce("canonical_id", "entity_id"))
    own = F.col("entity_id") == F.col("canonical_id")
    return j.groupBy(F.col("canonical_id").alias("entity_id")).agg(
        F.max(F.when(own, F.col("canonical_name"))).alias("canonical_name"), F.sum("mention_count").alias("mention_count"),
        F.max("wikidata_qid").alias("wikidata_qid"), F.array_sort(F.collect_set("canonical_name")).alias("aliases"),
    )


def rewire(links: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """#146. Links whose entity columns point to canonical entities, each link once."""
    for c in columns:
        m = mapping.select(F.col("entity_id").alias("_e"), F.col("canonical_id").alias("_c"))
        links = links.join(m, links[c] == m["_e"], "left").withColumn(c, F.coalesce("_c", c)).drop("_e", "_c")
    return links.distinct()


def resolve(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """#147. Incoming (mention_id, name, kind, qid) matched by QID, else by key; (mention_id, entity_id, method)."""
    by_qid = known.filter("wikidata_qid IS NOT NULL").groupBy(F.col("wikidata_qid").alias("qid")).agg(F.min("entity_id").alias("_q"))
    by_key = known.groupBy(T.entity_key(F.col("canonical_name"), F.col("entity_type")).alias("_key")).agg(F.min("entity_id").alias("_k"))
    j = incoming.withColumn("_key", T.entity_key(F.col("name"), F.col("kind"))).join(by_qid, "qid", "left").join(by_key, "_key", "left")
    return j.select("mention_id", F.coalesce("_q", "_k").alias("entity_id"), F.when(F.col("_q").isNotNull(), "qid").when(F.col("_k").isNotNull(), "key").otherwise("new").alias("method"))


def _indel(a: str, b: str) -> float:
    """100 times the share of both strings' characters that are in their longest common subsequence."""
    if not a and not b:
        return 100.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:  # a zero bit is a character of a in the subsequence
        u = row & at.get(c, 0)
        row = (row + u | row - u) & full
    return 200 * (len(a) - row.bit_count()) / (len(a) + len(b))


def name_ratio(a: str, b: str, subset: bool) -> float:
    """#148. Similarity 0 to 100 of two names: of their sorted tokens, or, with ``subset``, the best of the
    shared tokens and each side's; names of which one has all tokens of the other have 100."""
    x, y = a.split(), b.split()
    if not subset:
        return _indel(" ".join(sorted(x)), " ".join(sorted(y)))
    if not x or not y:
        return 0.0
    both = sorted(set(x) & set(y))
    left, right = sorted(set(x) - set(y)), sorted(set(y) - set(x))
    if both and not (left and right):
        return 100.0
    shared, one, two = " ".join(both), " ".join(both + left), " ".join(both + right)
    return max([_indel(one, two), *([_indel(shared, one), _indel(shared, two)] if both else [])])


@F.pandas_udf(DoubleType())
def _name_ratios(a: pd.Series, b: pd.Series, subset: pd.Series) -> pd.Series:
    return pd.Series([name_ratio(*x) for x in zip(a, b, subset)], dtype=float)


def fuzzy_matches(mentions: DataFrame, entities: DataFrame, least: float = 85.0) -> DataFrame:
    """#148. For each mention (mention_id, name, kind) the best entity of its type with a token in common
    and a ratio of ``least``: of token sets for persons, of sorted tokens otherwise.  An entity's names
    are its canonical_name and, if there are such columns, wikidata_label and aliases (an array).
    Null names match nothing; ties go to the smallest entity_id."""
    names = [F.array("canonical_name")] + [F.array(c) for c in ("wikidata_label",) if c in entities.columns] + [F.col(c) for c in ("aliases",) if c in entities.columns]
    names = F.array_compact(F.concat(*[F.coalesce(n, F.array().cast("array<string>")) for n in names]))
    token = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("_t")
    m = mentions.select("mention_id", "kind", T.normalized_name(F.col("name")).alias("_n")).select("*", token("_n"))
    e = entities.select("entity_id", F.col("entity_type").alias("kind"), F.explode(names).alias("_e")).withColumn("_e", T.normalized_name(F.col("_e")))
    j = m.join(e.distinct().select("*", token("_e")), ["_t", "kind"]).select("mention_id", "kind", "_n", "entity_id", "_e").distinct()
    hits = j.withColumn("score", F.round(_name_ratios("_n", "_e", F.col("kind") == "PERSON"), 4)).filter(F.col("score") >= least)
    return top_k(hits, ["mention_id"], [F.desc("score"), F.asc("entity_id")], 1).select("mention_id", "entity_id", "score")


def identify(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, external: DataFrame) -> DataFrame:
    """#149. Cascade: exact name 1.0, alias .95, fuzzy its ratio, external candidate its score, new .7; names
    of under 2 characters are skipped.  ``aliases`` (entity_id, alias), ``external`` (mention_id, qid, score)."""
    m = mentions.filter(F.length("name") >= 2).withColumn("_n", T.normalized_name(F.col("name")))
    exact = entities.groupBy(T.normalized_name(F.col("canonical_name")).alias("_n"), F.col("entity_type").alias("kind")).agg(F.min("entity_id").alias("_x"))
    alias = aliases.groupBy(T.normalized_name(F.col("alias")).alias("_n")).agg(F.min("entity_id").alias("_a"))
    left = m.join(exact, ["_n", "kind"], "left").join(alias, "_n", "left")
    open_ = left.filter("_x IS NULL AND _a IS NULL").select("mention_id", "name", "kind")
    fz = fuzzy_matches(open_, entities).select("mention_id", F.col("entity_id").alias("_f"), (F.col("score") / 100).alias("_fs"))
    ex = top_k(external, ["mention_id"], [F.desc("score"), F.asc("qid")], 1).select("mention_id", F.col("qid").alias("_q"), F.col("score").alias("_qs"))
    j = left.join(fz, "mention_id", "left").join(ex, "mention_id", "left")
    how = F.when(F.col("_x").isNotNull(), "exact").when(F.col("_a").isNotNull(), "alias").when(F.col("_f").isNotNull(), "fuzzy").when(F.col("_q").isNotNull(), "external").otherwise("new")
    conf = F.when(how == "exact", 1.0).when(how == "alias", 0.95).when(how == "fuzzy", F.col("_fs")).when(how == "external", F.col("_qs")).otherwise(0.7)
    return j.select("mention_id", F.coalesce("_x", "_a", "_f", "_q").alias("target"), how.alias("method"), F.round(conf, 6).alias("confidence"))


def constraints(relations: DataFrame) -> DataFrame:
    """#150. (mention, constraints): the kinds of relation that a mention has, by its side."""
    s = relations.select(F.col("subject").alias("mention"), F.concat(F.col("predicate"), F.lit(":from")).alias("c"))
    o = relations.select(F.col("object").alias("mention"), F.concat(F.col("predicate"), F.lit(":to")).alias("c"))
    return s.unionByName(o).groupBy("mention").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("constraints"))


def disambiguate(candidates: DataFrame, temperature: float = 5.0, accept: float = 0.70, alone: float = 0.35, margin: float = 1.3) -> DataFrame:
    """#152. Per mention the best external candidate (mention_id, qid, label_match, ratio, rank, likelihood):
    prior by softmax of a label score (20, or 15 times the ratio) and 10 over the rank, posterior by
    likelihood cubed.  Accepted at ``accept``, or at ``alone`` and ``margin`` times the second best."""
    score = F.when(F.col("label_match"), 20.0).otherwise(15 * F.col("ratio")) + 10 / F.col("rank")
    per = Window.partitionBy("mention_id")
    c = candidates.withColumn("_s", score)
    c = c.withColumn("_p", F.exp((F.col("_s") - F.max("_s").over(per)) / temperature))
    c = c.withColumn("_w", F.col("_p") / F.sum("_p").over(per) * F.pow("likelihood", F.lit(3)))
    total = F.sum("_w").over(per)
    c = c.withColumn("posterior", F.round(F.when(total > 0, F.col("_w") / total).otherwise(0.0), 6))
    order = per.orderBy(F.desc("posterior"), "qid")
    c = c.withColumns({"_r": F.row_number().over(order), "_second": F.coalesce(F.lead("posterior").over(order), F.lit(0.0))}).filter("_r = 1")
    ok = (F.col("posterior") >= accept) | ((F.col("posterior") >= alone) & (F.col("posterior") >= margin * F.col("_second")))
    return c.select("mention_id", "qid", "posterior", ok.alias("accepted"))


def subclasses(pairs: DataFrame, max_depth: int = 5) -> DataFrame:
    """#153. (child, ancestor, depth): the least depth of each ancestor over (child, parent) pairs."""
    front = cut_lineage(pairs.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct(), "classes")
    out = front
    for depth in range(2, max_depth + 1):
        up = pairs.select(F.col("child").alias("ancestor"), F.col("parent").alias("_p"))
        front = cut_lineage(front.join(up, "ancestor").select("child", F.col("_p").alias("ancestor"), F.lit(depth).alias("depth")).distinct(), "classes")
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out.groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))


def proper_names(df: DataFrame, text: str, stop: tuple[str, ...] = ("The", "A", "An", "In", "On", "It", "And")) -> DataFrame:
    """#154. (id, names): sorted capitalised words of a text that don't only start it."""
    w = F.filter(F.split(F.col(text), r"\s+"), lambda x: x.rlike(r"^[A-Z][a-z]+") & ~x.isin(*stop))
    clean = F.array_sort(F.array_distinct(F.transform(w, lambda x: F.regexp_replace(x, r"[^\w]", ""))))
    return df.select("id", F.array_join(clean, ",").alias("names"))


def valid_relations(relations: DataFrame, entities: DataFrame, predicates: tuple[str, ...] = ("PART_OF", "LOCATED_IN", "WORKS_FOR", "MEMBER_OF", "AFFILIATED_WITH")) -> DataFrame:
    """#156. Relations of known predicates between known entities, each once."""
    e = entities.select("entity_id")
    r = relations.filter(F.col("predicate").isin(*predicates) & (F.col("subject") != F.col("object")))
    r = r.join(e.withColumnRenamed("entity_id", "subject"), "subject", "left_semi").join(e.withColumnRenamed("entity_id", "object"), "object", "left_semi")
    return r.select("subject", "predicate", "object").distinct()


# Bylines of organisations, and patterns of style sheets and biographies.
ORGANISATION_BYLINES = (
    "ap staff", "reuters staff", "staff", "staff writer", "staff reporter", "associated press", "reuters", "afp", "ap",
    "editorial board", "news desk", "newsroom", "the editors", "admin", "contributor",
)
STYLE_PATTERNS = (
    r"\b(display|flex|width|height|position|relative|absolute|padding|margin|align|justify)\b",
    r"\b(font-size|font-weight|color|background|border|overflow|opacity)\b",
    r"\.wp-block", r"\bpx\b", r":\s*\d+", r"#[0-9a-fA-F]{3,6}\b",
)
BIO_PATTERNS = (
    r"\b(covers?|report(s|ing)?|based in|joined|received|graduated)\b",
    r"\b(editor|correspondent|contributor|writer|journalist)\b.*\b(at|for|with)\b",
    r"\b\d{4}\b", r"\bB\.S\.|M\.A\.|Ph\.D\.",
)


# What gives way in a part of a byline, in this order, and by what; signs that no name has.
NAME_RULES = (
    (r"(?i)^(by|written by|author[s]?:?)\s*", ""),
    (r"(?i)^(more|additional)\s+", ""),
    (r"[.,;:]+$", ""),
    (r"\s*\([^)]+\)\s*", " "),
    (r"\S+@\S+\.\S+", ""),
)
NO_NAME = r"[\p{Nd}<>{}\[\]@#$%^*+=]"


def _name_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _looks_like_name(text: Column) -> Column:
    """Two to four words, the first with a capital or in capitals, without digits and signs."""
    w = _name_words(text)
    first = F.get(w, F.lit(0))
    capital = first.rlike(r"^\p{Lu}") | (first.rlike(r"\p{Lu}") & ~first.rlike(r"[\p{Ll}\p{Lt}]"))
    return F.coalesce(F.size(w).between(2, 4) & capital & ~text.rlike(NO_NAME), F.lit(False))


def _clean_name(part: Column) -> Column:
    """A part of a byline without what stands before a name, marks, parentheses and mail addresses."""
    without = reduce(lambda name, rule: F.regexp_replace(name, *rule), NAME_RULES, F.trim(part))
    return F.array_join(_name_words(without), " ")


def authors(df: DataFrame, byline: str = "byline") -> DataFrame:
    """#155. (id, author, is_organisation, confidence) from bylines, in their order.

    One sign of a style sheet makes a byline junk; it is cut where the first kind of biography that occurs
    starts.  It is split at commas, ampersands, semicolons, bars and slashes, and at "and" if all
    parts look like names.  Cleaned names of 3 to 50 characters and at most 5 words count, each once
    in any case: organisations at .9, and what looks like a name at .95, or .8 if a word is small.
    Null and empty bylines have none.
    """
    line = F.col(byline)
    junk = reduce(lambda x, y: x | y, [line.rlike("(?i)" + p) for p in STYLE_PATTERNS])
    starts = [F.regexp_instr(line, F.lit("(?i)" + p)) for p in BIO_PATTERNS]
    kept = F.coalesce(*[F.when(at > 0, F.trim(F.substring(line, F.lit(1), at - 1))) for at in starts], line)

    def at_and(part: Column) -> Column:
        names = F.split(part, r"(?i)\s+and\s+")
        return F.when(F.forall(names, _looks_like_name), names).otherwise(F.array(part))

    parts = F.flatten(F.transform(F.split(kept, ","), at_and))
    parts = F.flatten(F.transform(parts, lambda x: F.split(x, r" & |;|\||/")))
    names = F.filter(F.transform(parts, _clean_name), lambda x: F.length(x).between(3, 50) & (F.size(_name_words(x)) <= 5))
    d = df.select("id", F.when(~junk, names).alias("_names")).withColumn("_low", F.transform("_names", F.lower))
    once = F.filter("_names", lambda x, i: F.array_position(F.col("_low"), F.lower(x)) == i + 1)
    name = d.select("id", F.explode(once).alias("author"))
    org = F.lower("author").isin(*ORGANISATION_BYLINES)
    words = _name_words(F.col("author"))
    whole = F.forall(words, lambda w: w.rlike(r"^\p{Lu}") | ((F.size(words) == 3) & w.startswith("-"))) & F.size(words).isin(2, 3)
    out = name.withColumn("is_organisation", org).filter(org | _looks_like_name(F.col("author")))
    return out.select("id", "author", "is_organisation", F.when(org, 0.9).when(whole, 0.95).otherwise(0.8).alias("confidence"))
