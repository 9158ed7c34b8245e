"""Column functions over texts, URLs, dates and keys (rows 61, 72-74, 133-135, 141-142, 151, 157-178)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topics and the patterns of their numbers, in order.
TOPIC_PATTERNS = {
    "casualty_count": (
        r"(\d+)\s+(?:people\s+)?(?:have\s+)?died",
        r"(\d+)\s+(?:people\s+)?(?:have\s+been\s+)?(?:confirmed\s+)?dead",
        r"(\d+)\s+(?:people\s+)?(?:were\s+)?killed",
        r"(?:death\s+toll|fatalities)(?:\s+(?:rises?|jumps?)\s+to\s+)?[:\s]*(\d+)",
        r"claimed?\s+(?:at\s+least\s+)?(\d+)\s+lives",
        r"(?:at\s+least\s+)?(\d+)\s+(?:people\s+)?(?:have\s+been\s+)?(?:confirmed\s+)?dead",
    ),
    "missing_count": (r"(\d+)\s+(?:people\s+)?(?:are\s+)?missing", r"(\d+)\s+unaccounted\s+for"),
    "injured_count": (r"(\d+)\s+(?:people\s+)?(?:were\s+)?injured", r"(\d+)\s+(?:people\s+)?(?:have\s+been\s+)?wounded"),
    "alarm_level": (r"(?:alarm\s+)?level\s+(\d+)", r"raised\s+to\s+level\s+(\d+)"),
    "evacuated_count": (r"(\d+)\s+(?:people\s+)?evacuated", r"(\d+)\s+(?:residents\s+)?rescued"),
}

# Substrings of a domain or site name by source type, in order; words of news domains.
DOMAIN_PATTERNS = {
    "wire": ("ap", "reuters", "afp", "apnews", "xinhua", "efe", "ansa", "dpa"),
    "official": ("gov", ".gov."),
    "aggregator": ("msn.com", "yahoo.com", "news.google", "flipboard"),
}
NEWS_WORDS = ("news", "times", "post", "herald", "tribune", "daily", "gazette")

# Prior of a source type, and what a byline adds to it.
SOURCE_PRIORS = {
    "wire": (0.60, 0.05), "newspaper": (0.55, 0.05), "broadcaster": (0.58, 0.05), "magazine": (0.55, 0.05),
    "official": (0.55, 0.0), "aggregator": (0.50, 0.0), "unknown": (0.50, 0.0),
}

# Query parameters that only track.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "_ga", "_gl", "ref", "source", "campaign",
)

# Words that mark a claim's role.
ROLE_PATTERNS = {
    "denial": r"\b(denies|deny|denied|refutes?|refuted|rejects?|rejected|dismisses?|dismissed|not guilty|pleaded not guilty)\b",
    "confirmation": r"\b(confirms?|confirmed|verif(y|ies|ied)|verifie|acknowledges?|acknowledged|admits?|admitted)\b",
    "institutional": r"\b(sentenced|ruled|ordered|filed|issued|imposed|sanctioned|charged|indicted|convicted|acquitted|appealed)\b",
    "assertion": r"\b(claims?|claimed|alleges?|alleged|says?|said|states?|stated|according to|reports?|reported|accuses?|accused)\b",
}

# Premise checks.
MODALITIES = ("observation", "reported_speech", "allegation", "opinion")
HEDGES = ("reportedly", "allegedly", "might have", "may have", "rumored", "unconfirmed")
CRIMES = ("murdered", "killed", "assassinated", "raped", "trafficked", "kidnapped")

# Words that give a time's precision, the finest first.
PRECISION_WORDS = {
    "hour": ("today", "yesterday", "this morning", "tonight", "hour", "minute", "am", "pm"),
    "day": ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "last week", "this week"),
    "month": (
        "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
        "last month", "this month", "early", "late", "mid-",
    ),
    "year": ("year", "decade", "century", "ago"),
}

# Negations of the lexical relation rule, and causal words.
NEGATIONS = ("not", "no", "never", "denied", "false", "wrong")
CAUSAL_WORDS = ("because", "caused", "led to", "result", "due to", "triggered", "sparked")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text contains one of the words."""
    return F.arrays_overlap(F.array(F.lit(True)), F.array(*[text.contains(w) for w in words]))


def first_number(text: Column, patterns: tuple[str, ...]) -> Column:
    """The number that the first matching pattern captures, or null."""
    lower = F.lower(text)
    return F.coalesce(*[F.nullif(F.regexp_extract(lower, p, 1), F.lit("")) for p in patterns]).cast("long")


def topic_of(text: Column) -> Column:
    """#61. The first topic whose patterns find a number in the text, or null."""
    return F.coalesce(*[F.when(first_number(text, p).isNotNull(), F.lit(t)) for t, p in TOPIC_PATTERNS.items()])


def topic_value(text: Column, topic: Column) -> Column:
    """#61. The number of the given topic in the text, or null."""
    return F.coalesce(*[F.when(topic == t, first_number(text, p)) for t, p in TOPIC_PATTERNS.items()])


def source_type(domain: Column, site: Column) -> Column:
    """#72. Source type by substrings of the domain or site name; 'unknown' without a domain."""
    d, s = F.lower(domain), F.lower(F.coalesce(site, F.lit("")))
    out = F.when(domain.isNull() | (domain == ""), "unknown")
    for kind, parts in DOMAIN_PATTERNS.items():
        out = out.when(any_of(d, parts) | any_of(s, parts), kind)
    return out.when(any_of(d, NEWS_WORDS), "newspaper").otherwise("unknown")


def has_byline(kind: Column) -> Column:
    """#72. Whether sources of the type sign their articles."""
    return kind.isin("wire", "newspaper")


def base_prior(kind: Column, byline: Column) -> Column:
    """#74. Prior of a source type, with what a byline adds."""
    base = F.coalesce(*[F.when(kind == k, F.lit(b)) for k, (b, _) in SOURCE_PRIORS.items()], F.lit(0.5))
    more = F.coalesce(*[F.when(kind == k, F.lit(x)) for k, (_, x) in SOURCE_PRIORS.items()], F.lit(0.0))
    return F.round(base + F.when(byline, more).otherwise(0.0), 2)


def words(text: Column) -> Column:
    """The set of lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """#133. Size of the intersection over that of the union of two arrays; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)


def proper_nouns(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b)"), 1))


def structural_similarity(a: Column, b: Column) -> Column:
    """#134. Half shared numbers, half shared proper nouns, each over the longer list."""
    def share(x: Column, y: Column) -> Column:
        most = F.greatest(F.size(x), F.size(y))
        return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / most).otherwise(0.0)

    return 0.5 * share(numbers(a), numbers(b)) + 0.5 * share(proper_nouns(a), proper_nouns(b))


def citations(text: Column) -> Column:
    """#135. Named sources: according to X, X reported, X said, citing X."""
    name = r"([A-Z][a-zA-Z\s]+)"
    found = [F.regexp_extract_all(text, F.lit(p), 1) for p in (rf"according to (?:the )?{name}", rf"(?:the )?{name} reported", rf"(?:the )?{name} said", rf"citing (?:the )?{name}")]
    return F.filter(F.transform(F.concat(*found), F.trim), lambda x: x != "")


def normalized_name(name: Column) -> Column:
    """#141. Lower case without possessives and punctuation, single spaces."""
    s = F.regexp_replace(F.lower(name), r"['’]s\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\w\s-]", ""), r"\s+", " "))


def entity_key(name: Column, kind: Column) -> Column:
    """#142. Key of an entity: 16 hex digits of the SHA-256 of its normalised name and type."""
    return F.substring(F.sha2(F.concat_ws("|", normalized_name(name), kind), 256), 1, 16)


def claim_id(url: Column, text: Column, version: str = "1.0") -> Column:
    """#142. Deterministic claim id from version, URL and text."""
    return F.concat(F.lit("clm_"), F.substring(F.sha2(F.concat_ws("|", F.lit(version), url, text), 256), 1, 16))


def domain(url: Column) -> Column:
    """#159. Host in lower case without ``www.``; empty without one."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """#157. Canonical form: host without ``www.``, no fragment or tracking parameters, the others sorted by
    name with their first value, no trailing slash unless there was a query."""
    whole = F.regexp_replace(url, r"#.*$", "")
    query = F.regexp_extract(whole, r"\?(.*)$", 1)
    path = F.regexp_extract(whole, r"^[^:/?#]+://[^/?#]*([^?]*)", 1)
    path = F.when((query != "") | (path == "/"), path).otherwise(F.regexp_replace(path, r"/+$", ""))
    pairs = F.filter(F.split(query, "&"), lambda p: p.contains("=") & (F.substring_index(p, "=", -1) != ""))
    named = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, r"^[^=]*=", "").alias("v")))
    kept = F.filter(named, lambda p: ~F.lower(p["k"]).isin(*TRACKING_PARAMS))
    keys = F.array_sort(F.array_distinct(F.transform(kept, lambda p: p["k"])))
    clean = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.filter(kept, lambda p: p["k"] == k)[0]["v"])), "&")
    scheme = F.lower(F.regexp_extract(url, r"^([^:/?#]+)://", 1))
    return F.concat(scheme, F.lit("://"), domain(url), path, F.when(clean != "", F.concat(F.lit("?"), clean)).otherwise(""))


def urls_in(text: Column) -> Column:
    """#160. URLs in a text, without punctuation at their end."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"]+)"), 1), lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", ""))


# Where a page says when it was published, in order; then fields of JSON-LD, in order.
PUBLISHED_PATTERNS = (
    r"""<meta[^>]+property=["']article:published_time["'][^>]+content=["']([^"']+)["']""",
    r"""<meta[^>]+content=["']([^"']+)["'][^>]+property=["']article:published_time["']""",
    r"""<meta[^>]+name=["']datePublished["'][^>]+content=["']([^"']+)["']""",
    r"""<meta[^>]+content=["']([^"']+)["'][^>]+name=["']datePublished["']""",
    r"""<meta[^>]+itemprop=["']datePublished["'][^>]+content=["']([^"']+)["']""",
    r"""<meta[^>]+name=["']dcterms\.created["'][^>]+content=["']([^"']+)["']""",
    r"""<meta[^>]+content=["']([^"']+)["'][^>]+name=["']dcterms\.created["']""",
    r"""<meta[^>]+name=["']dc\.date["'][^>]+content=["']([^"']+)["']""",
    r"""<meta[^>]+content=["']([^"']+)["'][^>]+name=["']dc\.date["']""",
    r"""<time[^>]+datetime=["']([^"']+)["']""",
)
PUBLISHED_FIELDS = ("datePublished", "publishDate", "dateCreated", "uploadDate")
# Kinds of JSON-LD items that name a site.
SITE_TYPES = ("NewsMediaOrganization", "Organization", "WebSite")
LD_PATTERN = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
#: Forms of dates that are read besides ISO 8601, after a weekday or not.
DATE_FORMS = ("d MMM yyyy HH:mm:ss Z", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "MM/dd/yyyy")


def read_time(text: Column) -> Column:
    """A timestamp from a date as pages write it, or null."""
    day = F.regexp_replace(text, r"^\s*[A-Za-z]+,\s*", "")
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(day, F.lit(f)) for f in DATE_FORMS])


def _ld_items(html: Column) -> Column:
    """The JSON-LD scripts of a page; of one that is an array, its first item."""
    scripts = F.regexp_extract_all(html, F.lit(LD_PATTERN), 1)
    return F.transform(scripts, lambda x: F.coalesce(F.get_json_object(x, "$[0]"), x))


def published(html: Column) -> Column:
    """#161. Publication time: the first of the meta and time tags that gives one, then of the JSON-LD
    scripts, where the first item of a graph stands for the script."""
    tags = [read_time(F.nullif(F.regexp_extract(html, "(?i)" + p, 1), F.lit(""))) for p in PUBLISHED_PATTERNS]
    items = F.transform(_ld_items(html), lambda x: F.coalesce(F.get_json_object(x, "$.@graph[0]"), x))
    times = F.transform(items, lambda x: F.coalesce(*[read_time(F.get_json_object(x, f"$.{k}")) for k in PUBLISHED_FIELDS]))
    return F.coalesce(*tags, F.get(F.array_compact(times), F.lit(0)))


def site_name(html: Column) -> Column:
    """#162. Site name: og:site_name, application-name, then of each JSON-LD script the first named item of
    ``SITE_TYPES`` in its graph, or else its publisher."""

    def tag(attribute: str, key: str) -> Column:
        a, c = rf"""{attribute}=["']{key}["']""", r"""content=["']([^"']+)["']"""
        return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(html, f"(?i)<meta[^>]+{x}", 1)), F.lit("")) for x in (f"{a}[^>]+{c}", f"{c}[^>]+{a}")])

    def of_script(x: Column) -> Column:
        graph = F.from_json(F.get_json_object(x, "$.@graph"), "array<struct<`@type`:string,name:string>>")
        named = F.filter(graph, lambda i: i["@type"].isin(*SITE_TYPES) & (i["name"] != ""))
        return F.coalesce(F.get(named, F.lit(0))["name"], F.nullif(F.get_json_object(x, "$.publisher.name"), F.lit("")))

    return F.coalesce(tag("property", "og:site_name"), tag("name", "application-name"), F.get(F.array_compact(F.transform(_ld_items(html), of_script)), F.lit(0)))


def is_update_of(newer: Column, older: Column) -> Column:
    """#62. Whether one claim updates another, as structs (topic, value, reported_time, event_time): the same
    topic and another value, not reported earlier, and of reports of one time not about an earlier
    event.  Unknown times forbid nothing; an unknown topic or value is no update."""
    same = newer["reported_time"] == older["reported_time"]
    early = (newer["reported_time"] < older["reported_time"]) | (same & (newer["event_time"] < older["event_time"]))
    return F.coalesce((newer["topic"] == older["topic"]) & (newer["value"] != older["value"]), F.lit(False)) & ~F.coalesce(early, F.lit(False))


def filled_share(*columns: Column) -> Column:
    """#164. Share of the columns that are neither null nor empty."""
    return sum((F.coalesce(c.cast("string") != "", F.lit(False)).cast("int") for c in columns), F.lit(0)) / len(columns)


def word_count(text: Column) -> Column:
    """#165. Words between white space."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+"))).cast("long")


def sane_confidence(c: Column) -> Column:
    """#168. .7 for null or values outside 0 to 1; at most .99, three digits."""
    return F.round(F.least(F.when(c.between(0, 1), c).otherwise(0.7), F.lit(0.99)) + 1e-9, 3)


def time_precision(context: Column, when: Column) -> Column:
    """#170. hour, day, month or year, by words of the context or else the form of the time."""
    low = F.lower(F.coalesce(context, F.lit("")))
    out = F.when(any_of(low, PRECISION_WORDS["hour"]), "hour")
    for p in ("day", "month", "year"):
        out = out.when(any_of(low, PRECISION_WORDS[p]), p)
    dashes = F.length(when) - F.length(F.replace(when, F.lit("-"), F.lit("")))
    return out.when(when.contains("T") & when.contains(":"), "hour").when(dashes == 2, "day").when(dashes == 1, "month").otherwise("year")


def event_time(date: Column, time: Column, zone: Column) -> Column:
    """#169. Timestamp of a date, its time (noon if none) and zone (UTC if none)."""
    return F.try_to_timestamp(F.concat(date, F.lit("T"), F.coalesce(time, F.lit("12:00:00")), F.coalesce(zone, F.lit("+00:00"))))


def premise_checks(text: Column, who: Column, date: Column, modality: Column, evidence: Column) -> Column:
    """#167. The names of failed checks: attribution, temporal, modality, evidence, hedging, controversy."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = F.exists(F.coalesce(who, F.array().cast("array<string>")), lambda w: w.contains(":"))
    ok_modality = F.coalesce(modality.isin(*MODALITIES), F.lit(False))
    return F.array_compact(F.array(
        F.when(~named, "attribution"),
        F.when(F.coalesce(date, F.lit("")) == "", "temporal"),
        F.when(~ok_modality, "modality"),
        F.when(F.size(F.coalesce(evidence, F.array().cast("array<string>"))) == 0, "evidence"),
        F.when(any_of(low, HEDGES), "hedging"),
        F.when(any_of(low, CRIMES) & ~F.coalesce(modality.isin("observation", "allegation"), F.lit(False)), "controversy"),
    ))


#: What each failed check takes from the confidence.
PENALTIES = {"attribution": 0.15, "temporal": 0.10, "modality": 0.15, "evidence": 0.10, "hedging": 0.20, "controversy": 0.25}


def premise_score(confidence: Column, failed: Column) -> Column:
    """#167. The confidence less the penalties of the failed checks, 0 at least."""
    penalty = F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in kv])
    total = F.aggregate(failed, F.lit(0.0), lambda a, f: a + F.element_at(penalty, f))
    return F.round(F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.7)) - total), 6)


def role(text: Column, updates: Column, contradicts: Column) -> Column:
    """#174. Role of a claim: by its edges, then by the first kind of words that it has."""
    low = F.lower(text)
    out = F.when(updates > 0, "update").when(contradicts > 0, "contradiction")
    for name, pattern in ROLE_PATTERNS.items():
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("occurrence")


def lexical_relation(a: Column, b: Column, similarity: Column) -> Column:
    """#176. CORROBORATES above .7; above .4 CONTRADICTS if only one side negates; else RELATED."""
    neg = F.array(*map(F.lit, NEGATIONS))
    odd = F.arrays_overlap(words(a), neg) != F.arrays_overlap(words(b), neg)
    return F.when(similarity > 0.7, "CORROBORATES").when(similarity > 0.4, F.when(odd, "CONTRADICTS").otherwise("CORROBORATES")).otherwise("RELATED")


def is_short_id(x: Column) -> Column:
    """#177. Two letters, an underscore, eight base-36 characters."""
    return x.rlike(r"^[a-z]{2}_[0-9a-z]{8}$")


def is_uuid(x: Column) -> Column:
    return F.lower(x).rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def short_id(prefix: str, uuid: Column) -> Column:
    """#177. Short id from a UUID: base 36 of its first ten hex digits, eight characters."""
    digits = F.lower(F.conv(F.substring(F.replace(uuid, F.lit("-"), F.lit("")), 1, 10), 16, 36))
    return F.concat(F.lit(prefix + "_"), F.lpad(digits, 8, "0"))


def attributions(text: Column) -> Column:
    """#178. Kinds of attribution in a text: according_to, said, told, official, quote."""
    who = r"[A-Z][a-z]+(?: [A-Z][a-z]+)*"
    checks = {"according_to": r"(?i)according to ", "said": rf"{who} said", "told": rf"{who} told", "official": r"(?i)\b(police|officials?|government|ministry|department)\b", "quote": r"[\"“][^\"”]{20,}[\"”]"}
    return F.array_compact(F.array(*[F.when(text.rlike(p), k) for k, p in checks.items()]))


def cited_claims(narrative: Column) -> Column:
    """#97. Claim ids in ``[cl_...]`` markers."""
    return F.array_distinct(F.regexp_extract_all(narrative, F.lit(r"\[(cl_[0-9a-z]+)\]"), 1))


def generic_name(name: Column) -> Column:
    """#151. Names that say too little: under 2 characters, digits alone, articles or kinds alone."""
    n = F.lower(F.trim(name))
    return F.coalesce((F.length(n) < 2) | n.rlike(r"^\d+$") | n.rlike(r"^(the|a|an|police|officials?|government|authorities|residents|victims|people|company|city|country)$"), F.lit(True))


# Patterns of a claim's attributes, in order, and phrases of an update.
ATTRIBUTES = {
    "death_toll": (
        r"(\d+)\s*(?:people\s+)?(?:were\s+|have\s+been\s+)?killed",
        r"(\d+)\s*(?:people\s+)?(?:have\s+)?died",
        r"(\d+)\s*(?:people\s+)?dead",
        r"death\s+toll[:\s]+(\d+)",
        r"death\s+toll\s+(?:rises\s+to|hits|of)\s+(\d+)",
        r"at\s+least\s+(\d+)\s+(?:people\s+)?(?:killed|dead|died)",
    ),
    "missing_count": (r"(\d+)\s+(?:people\s+)?(?:are\s+)?missing", r"(\d+)\s+(?:people\s+)?unaccounted"),
}
UPDATE_PHRASES = (
    "rises to", "risen to", "increased to", "now", "updated", "latest", "climbed to", "reached", "has grown", "hits", "surpasses",
)
# Places by attribute, as patterns; of those that match the last one holds.
PLACES = {"location": (r"(wang\s+fuk\s+court)", r"(tai\s+po(?:\s+district)?)"), "region": (r"(hong\s+kong)",)}

# Credibility of domains.
CREDIBILITY = {
    "bbc.com": 0.90, "reuters.com": 0.88, "apnews.com": 0.88, "theguardian.com": 0.85, "dw.com": 0.85, "cnn.com": 0.80,
    "scmp.com": 0.82, "aljazeera.com": 0.80, "newsweek.com": 0.70, "nypost.com": 0.60, "foxnews.com": 0.65,
}


def domain_credibility(url: Column, table: dict[str, float] | None = None, default: float = 0.5) -> Column:
    """#76. Credibility of the first domain of the table that the URL contains."""
    low = F.lower(url)
    return F.coalesce(*[F.when(low.contains(d), F.lit(c)) for d, c in (table or CREDIBILITY).items()], F.lit(default))


def relate_by_structure(a: Column, b: Column, places: dict[str, tuple[str, ...]] | None = None) -> Column:
    """#67. Relation of two texts by shared attributes: INDEPENDENT without one; CORROBORATES if all agree;
    CONTRADICTS if a place differs (numbers that differ always have a higher one); else UPDATES."""
    parts = [(first_number(a, p), first_number(b, p), "UPDATES") for p in ATTRIBUTES.values()]
    for p in (PLACES if places is None else places).values():
        got = lambda t: F.coalesce(*[F.nullif(F.regexp_extract(F.lower(t), x, 1), F.lit("")) for x in reversed(p)])  # noqa: B023, E731
        parts.append((got(a), got(b), "CONTRADICTS"))
    found = F.array_compact(F.array(*[F.when(x.isNotNull() & y.isNotNull(), F.when(x == y, "CORROBORATES").otherwise(kind)) for x, y, kind in parts]))
    return F.when(F.size(found) == 0, "INDEPENDENT").when(F.array_contains(found, "CONTRADICTS"), "CONTRADICTS").when(F.array_contains(found, "UPDATES"), "UPDATES").otherwise("CORROBORATES")


def newer_by_structure(a: Column, b: Column) -> Column:
    """#67. Which of two texts, "a" or "b", updates the other by the first number that they share and differ
    in: b if it speaks of an update or has the higher number, else a; null if no number differs."""
    numbers = [(first_number(a, p), first_number(b, p)) for p in ATTRIBUTES.values()]
    return F.coalesce(*[F.when(x != y, F.when(is_update_language(b) | (y > x), "b").otherwise("a")) for x, y in numbers])


def is_update_language(text: Column) -> Column:
    """#67. Whether a text has a phrase of an update."""
    return any_of(F.lower(text), UPDATE_PHRASES)
