"""Queries of rows 5-8, 136, 143-156."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators import entities as N
from claimloom.operators import scoring as S
from claimloom.operators.graph import shared_folder
from claimloom.plans.ctes import with_tables
from claimloom.plans.registry import query
from claimloom.sources import fixtures as X
from claimloom.sources import tables as IO


def q(name, body, **more):
    return query(name, with_tables(body, **more) if body else None)


NORM = r"trim(regexp_replace(regexp_replace(lower(canonical_name), '[^\w\s-]', '', 'g'), '\s+', ' ', 'g'))"
MAP = f"SELECT entity_id, first_value(entity_id) OVER (PARTITION BY {NORM}, entity_type ORDER BY wikidata_qid IS NULL, mention_count DESC, regexp_matches(canonical_name, '^[A-Z]')::INT + (len(string_split(trim(canonical_name), ' ')) > 1)::INT + (upper(canonical_name) <> canonical_name)::INT DESC, entity_id) AS canonical_id FROM kg_entities"


def mapping(s, d):
    return N.canonical(X.kg_entities(s, d), T.normalized_name(F.col("canonical_name")))


@q("q143_duplicate_names", f"SELECT {NORM} AS key, entity_type, count(*) AS size, string_agg(entity_id, ',' ORDER BY entity_id) AS ids FROM kg_entities GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return N.duplicate_groups(X.kg_entities(s, d), T.normalized_name(F.col("canonical_name")))


@q("q144_duplicate_qids", "SELECT wikidata_qid AS key, entity_type, count(*) AS size, string_agg(entity_id, ',' ORDER BY entity_id) AS ids FROM kg_entities WHERE wikidata_qid IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return N.duplicate_groups(X.kg_entities(s, d), F.col("wikidata_qid"))


@q("q145_canonical", "SELECT * FROM kg_map", kg_map=MAP)
def _(s, d):
    return mapping(s, d)


@q("q146_merged_entities", "SELECT m.canonical_id AS entity_id, sum(mention_count)::BIGINT AS mention_count, max(wikidata_qid) AS wikidata_qid, count(DISTINCT canonical_name) AS names FROM kg_entities e JOIN kg_map m ON e.entity_id = m.entity_id GROUP BY ALL", kg_map=MAP)
def _(s, d):
    return N.merge_entities(X.kg_entities(s, d), mapping(s, d)).select("entity_id", "mention_count", "wikidata_qid", F.size("aliases").cast("long").alias("names"))


@q("q146_rewired_mentions", "SELECT DISTINCT claim_id, canonical_id AS entity_id FROM kg_mentions x JOIN kg_map m ON x.entity_id = m.entity_id", kg_map=MAP)
def _(s, d):
    return N.rewire(X.kg_mentions(s, d).select("claim_id", "entity_id"), mapping(s, d), ["entity_id"])


@q("q147_resolved", f"""SELECT p.entity_id AS mention_id, COALESCE(a.e, b.e) AS entity_id, CASE WHEN a.e IS NOT NULL THEN 'qid' WHEN b.e IS NOT NULL THEN 'key' ELSE 'new' END AS method FROM (SELECT *, {NORM} AS n, CASE WHEN mention_count % 2 = 0 THEN wikidata_qid END AS qid FROM kg_entities) p
LEFT JOIN (SELECT wikidata_qid, min(entity_id) AS e FROM kg_entities WHERE mention_count > 25 AND wikidata_qid IS NOT NULL GROUP BY ALL) a ON p.qid = a.wikidata_qid LEFT JOIN (SELECT {NORM} AS n, entity_type, min(entity_id) AS e FROM kg_entities WHERE mention_count > 25 GROUP BY ALL) b ON p.n = b.n AND p.entity_type = b.entity_type""")
def _(s, d):
    e = X.kg_entities(s, d)
    inc = e.select(F.col("entity_id").alias("mention_id"), F.col("canonical_name").alias("name"), F.col("entity_type").alias("kind"), F.when(F.pmod("mention_count", F.lit(2)) == 0, F.col("wikidata_qid")).alias("qid"))
    return N.resolve(inc, e.filter("mention_count > 25"))


def _mentioned(s, d):
    e = X.kg_entities(s, d).filter("entity_type = 'PRODUCT'").groupBy("canonical_name").agg(F.min("entity_id").alias("mention_id"))
    return e.select("mention_id", F.concat("canonical_name", F.when(F.pmod(F.length("canonical_name"), F.lit(2)) == 0, "s").otherwise("")).alias("name"), F.lit("PRODUCT").alias("kind"))


@q("q148_fuzzy_matches", None)
def _(s, d):
    return N.fuzzy_matches(_mentioned(s, d), X.kg_entities(s, d), 85.0)


@q("q003_saved_snapshot", "SELECT c.claim_id, c.page_id, c.event_id, COALESCE(o.n, 0) AS n_out FROM kg_claims c LEFT JOIN (SELECT src, count(*) AS n FROM kg_claim_edges GROUP BY ALL) o ON c.claim_id = o.src")
def _(s, d):
    path = f"{shared_folder(s)}/snapshot-{uuid.uuid4().hex}"
    IO.save_snapshot(IO.build_snapshot(X.kg_claims(s, d), X.kg_mentions(s, d), X.kg_claim_edges(s, d)), path)
    claims, edges = IO.load_snapshot(s, path)
    n = edges.groupBy(F.col("src").alias("claim_id")).agg(F.count("*").alias("n_out"))
    return claims.select("claim_id", "page_id", "event_id").join(n, "claim_id", "left").withColumn("n_out", F.coalesce("n_out", F.lit(0)))


@q("q149_identified", None)
def _(s, d):
    e = X.kg_entities(s, d)
    al = e.filter("mention_count > 40").select("entity_id", F.concat("canonical_name", F.lit(" co")).alias("alias"))
    ext = _mentioned(s, d).select("mention_id", F.lit("Q1").alias("qid"), F.lit(0.8).alias("score"))
    return N.identify(_mentioned(s, d), e, al, ext)


REL = "SELECT src AS subject, dst AS object, CASE WHEN dst LIKE 'S%' THEN 'PART_OF' WHEN dst LIKE 'N%' THEN 'LOCATED_IN' ELSE 'NEAR' END AS predicate FROM kg_entity_edges"


def _relations(s, d):
    p = F.when(F.col("dst").startswith("S"), "PART_OF").when(F.col("dst").startswith("N"), "LOCATED_IN").otherwise("NEAR")
    return X.kg_entity_edges(s, d).select(F.col("src").alias("subject"), F.col("dst").alias("object"), p.alias("predicate"))


@q("q150_constraints", "SELECT mention, string_agg(DISTINCT c, ',' ORDER BY c) AS constraints FROM (SELECT subject AS mention, predicate || ':from' AS c FROM kg_rel UNION ALL SELECT object, predicate || ':to' FROM kg_rel) GROUP BY ALL", kg_rel=REL)
def _(s, d):
    return N.constraints(_relations(s, d))


@q("q151_generic_names", "SELECT entity_id, length(trim(canonical_name)) < 2 AS generic FROM kg_entities")
def _(s, d):
    return X.kg_entities(s, d).select("entity_id", T.generic_name(F.col("canonical_name")).alias("generic"))


@q("q152_disambiguated", """SELECT mention_id, qid, posterior, posterior >= 0.7 OR (posterior >= 0.35 AND posterior >= 1.3 * second) AS accepted FROM (SELECT *, row_number() OVER o AS r, COALESCE(lead(posterior) OVER o, 0) AS second FROM (
SELECT mention_id, qid, round(CASE WHEN sum(w) OVER (PARTITION BY mention_id) > 0 THEN w / sum(w) OVER (PARTITION BY mention_id) ELSE 0 END, 6) AS posterior FROM (SELECT *, p / sum(p) OVER (PARTITION BY mention_id) * pow(likelihood, 3) AS w FROM (SELECT *, exp((s - max(s) OVER (PARTITION BY mention_id)) / 5) AS p FROM (
SELECT mention_id, qid, likelihood, CASE WHEN m THEN 20::DOUBLE ELSE 15 * 0.6::DOUBLE END + 10::DOUBLE / rank AS s FROM kg_cand)))) WINDOW o AS (PARTITION BY mention_id ORDER BY posterior DESC, qid)) WHERE r = 1""",
   kg_cand="SELECT a.p_partkey AS mention_id, 'Q' || b.p_partkey AS qid, a.p_name = b.p_name AS m, b.p_partkey - a.p_partkey + 51 AS rank, (b.p_partkey * 37 % 100)::DOUBLE / 100 AS likelihood FROM part a JOIN part b ON a.p_type = b.p_type AND b.p_partkey BETWEEN a.p_partkey - 50 AND a.p_partkey + 50")
def _(s, d):
    p = X.read(s, d, "part").select("p_partkey", "p_name", "p_type")
    a, b = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"), "p_type", F.explode(F.sequence(F.floor((F.col("p_partkey") - 50) / 50), F.floor((F.col("p_partkey") + 50) / 50))).alias("block")), p.withColumn("block", F.floor(F.col("p_partkey") / 50))
    c = a.join(b, ["p_type", "block"]).filter(F.abs(F.col("p_partkey") - F.col("k")) <= 50)
    c = c.select(F.col("k").alias("mention_id"), F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("qid"), (F.col("n") == F.col("p_name")).alias("label_match"), F.lit(0.6).alias("ratio"), (F.col("p_partkey") - F.col("k") + 51).alias("rank"), (F.pmod(F.col("p_partkey") * 37, F.lit(100)) / 100).alias("likelihood"))
    return N.disambiguate(c)


@q("q153_subclasses", "SELECT child, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM (WITH RECURSIVE a AS (SELECT child, parent AS ancestor, 1 AS depth FROM kg_sub UNION SELECT a.child, s.parent, depth + 1 FROM a JOIN kg_sub s ON a.ancestor = s.child WHERE depth < 5) SELECT * FROM a) GROUP BY ALL", kg_sub="SELECT DISTINCT p_brand AS child, p_type AS parent FROM part UNION SELECT DISTINCT p_type, 'ROOT' FROM part")
def _(s, d):
    p = X.read(s, d, "part")
    return N.subclasses(p.select(F.col("p_brand").alias("child"), F.col("p_type").alias("parent")).union(p.select("p_type", F.lit("ROOT"))).distinct())


@q("q154_proper_names", r"""SELECT doc_id AS id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: regexp_matches(x, '^[A-Z][a-z]+') AND NOT list_contains(['The', 'A', 'An', 'In', 'On', 'It', 'And'], x)),
lambda x: regexp_replace(x, '[^\w]', '', 'g')))), ',') AS names FROM documents""")
def _(s, d):
    return N.proper_names(X.read(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "text")


# bylines around a name made of a part's, by kind; the SQL says who is in each
BYLINES = (
    "By {} and Ann Poe, Reuters", "{} and Ann", "display: flex {}", "{} covers trade in Bonn", "{} (Berlin); ann@x.org Ann Poe / ANN POE",
    "Written by {} | Staff Writer", "the {}, Jr", "More {} of The Old House Press Club",
)
BYLINE_SQL = """SELECT id, a.author, a.is_organisation, a.confidence FROM (SELECT p_partkey AS id, unnest(CASE p_partkey % 8
  WHEN 0 THEN [{'author': n, 'is_organisation': FALSE, 'confidence': 0.95::DOUBLE}, {'author': 'Ann Poe', 'is_organisation': FALSE, 'confidence': 0.95::DOUBLE}, {'author': 'Reuters', 'is_organisation': TRUE, 'confidence': 0.9::DOUBLE}]
  WHEN 1 THEN [{'author': n || ' and Ann', 'is_organisation': FALSE, 'confidence': 0.8::DOUBLE}]
  WHEN 3 THEN [{'author': n, 'is_organisation': FALSE, 'confidence': 0.95::DOUBLE}]
  WHEN 4 THEN [{'author': n, 'is_organisation': FALSE, 'confidence': 0.95::DOUBLE}, {'author': 'Ann Poe', 'is_organisation': FALSE, 'confidence': 0.95::DOUBLE}]
  WHEN 5 THEN [{'author': n, 'is_organisation': FALSE, 'confidence': 0.95::DOUBLE}, {'author': 'Staff Writer', 'is_organisation': TRUE, 'confidence': 0.9::DOUBLE}]
  END) AS a FROM (SELECT p_partkey, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS n FROM part))"""


@q("q155_authors", BYLINE_SQL)
def _(s, d):
    name = F.initcap("p_name")
    kind = F.pmod("p_partkey", F.lit(8))
    line = F.coalesce(*[F.when(kind == i, F.concat(F.lit(x.split("{}")[0]), name, F.lit(x.split("{}")[1]))) for i, x in enumerate(BYLINES)])
    return N.authors(X.read(s, d, "part").select(F.col("p_partkey").alias("id"), line.alias("byline")))


@q("q156_valid_relations", "SELECT DISTINCT subject, predicate, object FROM kg_rel WHERE predicate IN ('PART_OF', 'LOCATED_IN') AND subject IN (SELECT entity_id FROM kg_entities) AND object IN (SELECT entity_id FROM kg_entities)", kg_rel=REL)
def _(s, d):
    return N.valid_relations(_relations(s, d), X.kg_entities(s, d))


@q("q136_dependency", """SELECT src, dst, round(0.2::DOUBLE * (a.page_id = b.page_id)::INT + 0.1::DOUBLE * (a.part_entity = b.part_entity)::INT + 0.3::DOUBLE * (a.value % 2 = 0)::INT + CASE WHEN a.value % 2 = 0 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score FROM kg_claim_edges JOIN kg_claims a ON src = a.claim_id JOIN kg_claims b ON dst = b.claim_id""")
def _(s, d):
    c = X.kg_claims(s, d)
    side = lambda k: c.select(F.col("claim_id").alias(k), F.col("page_id").alias(f"p{k}"), F.col("part_entity").alias(f"e{k}"), F.col("value").alias(f"v{k}"))
    j = X.kg_claim_edges(s, d).join(side("src"), "src").join(side("dst"), "dst")
    sim = (F.pmod("vsrc", F.lit(2)) == 0).cast("double")
    return j.select("src", "dst", F.round(S.dependency(sim, F.lit(0.0), F.lit(False), F.col("psrc") == F.col("pdst"), (F.col("esrc") == F.col("edst")).cast("double")), 6).alias("score"))


@q("q005_upserted_entities", "SELECT entity_id, CASE WHEN mention_count > 25 THEN mention_count + 100 ELSE mention_count END AS mention_count FROM kg_entities")
def _(s, d):
    e = X.kg_entities(s, d).select("entity_id", "mention_count")
    new = e.filter("mention_count > 25").withColumn("mention_count", F.col("mention_count") + 100)
    return IO.upsert(e, new, ["entity_id"])


@q("q006_merged_pages", "SELECT page_id, title, CASE WHEN page_id % 4 = 0 THEN 7 ELSE word_count END AS word_count FROM kg_pages")
def _(s, d):
    p = X.kg_pages(s, d).select("page_id", "title", "word_count")
    new = p.filter("page_id % 4 = 0").select("page_id", F.lit(None).cast("string").alias("title"), F.lit(7).cast("long").alias("word_count"))
    return IO.merge_metadata(p, new, "page_id", keep_if_null=["title"])


@q("q007_replay", "SELECT page_id, pub_time, CAST(row_number() OVER (PARTITION BY event_id ORDER BY pub_time, page_id) AS INTEGER) AS position FROM kg_pages WHERE pub_time IS NOT NULL")
def _(s, d):
    return IO.replay(X.kg_pages(s, d), "event_id").select("page_id", "pub_time", "position")


@q("q008_page_scan", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^www\\.', '') AS domain, length(html) AS chars FROM pages")
def _(s, d):
    return IO.scan_pages(s, f"{d}/pages.parquet").select("page_id", "domain", F.length("html").cast("long").alias("chars"))


@q("q002_snapshot", """SELECT c.claim_id, c.page_id, c.event_id, 2 AS n_entities, COALESCE(o.n, 0) AS n_out, COALESCE(i.n, 0) AS n_in FROM kg_claims c LEFT JOIN (SELECT src, count(*) AS n FROM kg_claim_edges GROUP BY ALL) o ON c.claim_id = o.src LEFT JOIN (SELECT dst, count(*) AS n FROM kg_claim_edges GROUP BY ALL) i ON c.claim_id = i.dst""")
def _(s, d):
    snap = IO.build_snapshot(X.kg_claims(s, d), X.kg_mentions(s, d), X.kg_claim_edges(s, d))
    n = lambda *cs: sum((F.size(c) for c in cs), F.lit(0)).cast("long")
    return snap.select("claim_id", "page_id", "event_id", n("entity_ids").alias("n_entities"), n("corroborates_ids", "contradicts_ids", "updates_ids").alias("n_out"), n("corroborated_by_ids", "contradicted_by_ids", "updated_by_ids").alias("n_in"))


@q("q001_snapshot_edges", "SELECT src, dst, rel FROM kg_claim_edges")
def _(s, d):
    snap = IO.build_snapshot(X.kg_claims(s, d), X.kg_mentions(s, d), X.kg_claim_edges(s, d))
    return IO.snapshot_edges(snap)


@q("q163_main_texts", None)
def _(s, d):
    return IO.main_texts(X.read(s, d, "pages")).select("page_id", "method", F.length("content").cast("long").alias("chars"))


@q("q139_high_dependency", """SELECT src, dst, round(0.2::DOUBLE * (a.page_id = b.page_id)::INT + 0.1::DOUBLE * (a.part_entity = b.part_entity)::INT + 0.5::DOUBLE, 6) AS score FROM kg_claim_edges JOIN kg_claims a ON src = a.claim_id JOIN kg_claims b ON dst = b.claim_id WHERE a.page_id = b.page_id OR a.part_entity = b.part_entity ORDER BY 3 DESC, src, dst LIMIT 10""")
def _(s, d):
    c = X.kg_claims(s, d)
    side = lambda k: c.select(F.col("claim_id").alias(k), F.col("page_id").alias(f"p{k}"), F.col("part_entity").alias(f"e{k}"))
    j = X.kg_claim_edges(s, d).join(side("src"), "src").join(side("dst"), "dst")
    score = S.dependency(F.lit(1.0), F.lit(0.0), F.lit(False), F.col("psrc") == F.col("pdst"), (F.col("esrc") == F.col("edst")).cast("double"))
    return S.high_dependency(j.select("src", "dst", F.round(score, 6).alias("score")), 10, 0.5)
