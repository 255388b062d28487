"""PII: base patterns with positions, and terms that disclose a protected entity by co-occurrence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.catalog import query
from brindle.session import scratch, table

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. Possessive where nothing can follow, so that long runs neither recurse nor backtrack;
#: the look-behind of email and ip skips starts inside a run whose first start has failed already.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"
_SPACE = " \t\n\x0b\f\r"

#: A word is a term if, after stripping what is neither letter nor digit, it has so many characters.
MIN_TERM = 3
#: Terms are counted up to so many words before and after an entity's mention.
WINDOW = 8
#: A pair needs so many different contexts (one can't tell a link from chance), and a term so large a part
#: of the entity's information.
MIN_CONTEXTS, DISCLOSURE = 2, 0.9

_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def _no_spans() -> Column:
    return F.array().cast(_SPAN)


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Matches that ``keep(value)`` holds for, as structs with positions in code points. The pieces
    between matches and the matches take turns in the text, so their summed lengths are the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    turns = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), _no_spans().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        since = acc["at"] + F.char_length(x["b"])
        upto = since + F.char_length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), since.alias("start"), upto.alias("end"), x["m"].alias("value"))
        return F.struct(upto.alias("at"), F.when(keep(x["m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, step)["out"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return ~F.exists(parts, lambda p: (F.length(p) > 3) | (F.lpad(p, 3, "0") > "255"))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


#: A text without this can't match, which one search tells.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}


def base_spans(text: Column) -> Column:
    """The spans of all base kinds, in the order of KINDS, then by start; failing matches are dropped."""
    parts = [F.when(text.rlike(_HINTS[k]), _spans(text, PATTERNS[k], k, lambda v, k=k: _valid(k, v))).otherwise(_no_spans()) for k in KINDS]
    return F.concat(*parts)


def _term(word: Column) -> Column:
    """A word as a term: lower case, without what surrounds its letters and digits."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _entity(span: Column) -> Column:
    """An entity's name: its kind and value, numbers without their separators."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"])))


def _near(text: Column, span: Column) -> Column:
    """The terms among the WINDOW words on either side of a span, however long these are."""
    start, end = span["start"].cast("int"), span["end"].cast("int")
    reach = 40 * WINDOW  # holds so many ordinary words; where it doesn't, the whole side is split
    tail = F.substring(text, F.greatest(F.lit(1), start - reach + 1), F.least(start, F.lit(reach)))
    head = F.substring(text, end + 1, F.lit(reach))
    # of more than WINDOW words, the one that the reach may have cut is not taken
    before = F.split(F.rtrim(tail, F.lit(_SPACE)), _GAP)
    before = F.when((start <= reach) | (F.size(before) > WINDOW), before).otherwise(F.split(F.rtrim(F.substring(text, F.lit(1), start), F.lit(_SPACE)), _GAP))
    after = F.split(F.ltrim(head, F.lit(_SPACE)), _GAP)
    after = F.when((F.char_length(head) < reach) | (F.size(after) > WINDOW), after).otherwise(F.split(F.ltrim(F.substring(text, end + 1, F.lit(2**31 - 1)), F.lit(_SPACE)), _GAP))
    words = F.concat(F.slice(before, F.greatest(F.lit(1), F.size(before) - WINDOW + 1), F.lit(WINDOW)), F.slice(after, F.lit(1), F.lit(WINDOW)))
    return F.filter(F.transform(words, _term), lambda t: F.char_length(t) >= MIN_TERM)


def find_base(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(key, doc_id, text, spans) and the columns ``keep``: the rows of ``docs(doc_id, text)`` with their
    base spans. Rows that agree in doc_id and text share a key, and everything that follows from it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text)))
    return docs.select(key.alias("key"), "doc_id", text.alias("text"), base_spans(text).alias("spans"), *keep)


def disclosing_terms(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, share): terms that disclose a protected entity.

    ``found`` comes from :func:`find_base` (rows with spans), ``docs(text)`` is the corpus. How strongly
    a term reveals an entity is their pointwise mutual information, log2(p(entity near the term) /
    p(entity near any word)). The most it can be is the entity's own information; ``share`` is the part
    of it that the term gives. Terms with DISCLOSURE or more of it, in MIN_CONTEXTS different contexts,
    disclose. Every entity with so many contexts is protected, however many rows hold it. Both counts
    cover the whole corpus, each distinct text and each context once, so copies change nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mentions = found.select(F.explode("spans").alias("s"), "text").select(_entity(F.col("s")).alias("entity"), _near(F.col("text"), F.col("s")).alias("near"))
    contexts = scratch(mentions.groupBy("entity", "near").agg(F.lit(1).alias("once")).select("entity", "near"), "pii-contexts")
    known = contexts.groupBy("entity").agg(F.count("*").alias("contexts"), F.sum(F.size("near")).alias("near_words")).where(F.col("contexts") >= MIN_CONTEXTS)
    pairs = contexts.select("entity", F.explode(F.array_distinct("near")).alias("term")).groupBy("entity", "term").agg(F.count("*").alias("together"))
    pairs = scratch(pairs.where(F.col("together") >= MIN_CONTEXTS).join(known.select("entity", "near_words"), "entity"), "pii-pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("share"))
    once = docs.select(text.alias("text")).groupBy(F.unhex(F.md5("text")).alias("key")).agg(F.first("text").alias("text"))
    spoken = once.select(F.explode(F.split("text", _GAP)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # counted before they are joined: a common word among the pairs then costs one row
    spoken = scratch(spoken.groupBy(_term(F.col("word")).alias("term")).agg(F.sum("n").alias("n")), "pii-spoken")
    words = spoken.agg(F.sum("n")).first()[0] or 0
    information = F.greatest(-F.log2(F.col("near_words") / F.lit(float(max(1, words)))), F.lit(1e-9))
    share = 1 + F.log2(F.least(F.col("together") / F.col("n"), F.lit(1.0))) / information
    return pairs.join(spoken, "term").select("entity", "term", share.alias("share")).where(F.col("share") >= DISCLOSURE)


def _term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Spans of the words that are among ``terms``, apart from those that touch a base span."""
    spans = _spans(text, WORD, "term", lambda w: F.array_contains(terms, _term(w)))

    def trim(s: Column) -> Column:
        lead = F.char_length(F.regexp_extract(s["value"], r"^[^\p{L}\p{N}]*", 0))
        own = F.regexp_replace(s["value"], r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
        return F.struct(s["kind"].alias("kind"), (s["start"] + lead).alias("start"), (s["start"] + lead + F.char_length(own)).alias("end"), own.alias("value"))

    return F.filter(F.transform(spans, trim), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def find_personal(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, spans) and the columns ``keep`` for each row of ``docs``: base spans, then those of kind ``term``, words that
    disclose an entity of the same text.

    A null text counts as empty and has no span; a null doc_id is kept; repeated rows get the same
    spans. Texts are searched whole; overlapping spans of different kinds all stand. Other columns are
    not read.
    """
    docs = docs.select("doc_id", "text", *keep)
    everything = find_base(docs, keep)
    found = scratch(everything.where(F.size("spans") > 0), "pii-found")
    terms = disclosing_terms(found, docs)
    entities = found.select("key", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity")).distinct()
    # gathered before they are joined: a hot entity then costs a row for each of its texts
    terms = terms.groupBy("entity").agg(F.collect_set("term").alias("terms"))
    told = entities.join(terms, "entity").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    marked = found.join(told, "key", "left")
    extra = F.when(F.col("terms").isNotNull(), _term_spans(F.col("text"), F.col("terms"), F.col("spans"))).otherwise(_no_spans())
    marked = marked.select("doc_id", "text", F.concat("spans", extra).alias("spans"), *keep)
    return marked.unionByName(everything.where(F.size("spans") == 0).select("doc_id", "text", "spans", *keep))


def sanitise(text: Column, spans: Column) -> Column:
    """The text with each entity generalised to its kind, as ``[EMAIL]``, and each disclosing term
    removed to ``[...]``. Of overlapping spans the first gives the mark for all."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        mark = F.when(s["kind"] == "term", F.lit("[...]")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], kept, mark)).otherwise(acc["out"]).alias("out"))

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(by_start, start, step)
    clean = F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.size(spans) == 0, text).otherwise(clean)


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sql() -> str:
    """The query as DuckDB SQL, in full: base spans, protected entities, disclosing terms."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda k: CASE WHEN k % 2 = 0 THEN d[length(d) - k]::INT WHEN d[length(d) - k]::INT > 4 THEN 2 * d[length(d) - k]::INT - 9 ELSE 2 * d[length(d) - k]::INT END)) % 10 = 0".replace("d[", f"{digits}[").replace("length(d)", f"length({digits})")
    valid = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(v, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE ('0' || p)::HUGEINT END)) <= 255",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }

    def spans(kind: str, pattern: str, source: str) -> str:
        at = "coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
        return f"""SELECT doc_id, text, '{kind}' AS kind, ({at})::BIGINT AS s, ({at} + length(m[i]))::BIGINT AS e, m[i] AS v
 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS b FROM {source}))"""

    base = " UNION ALL ".join(f"SELECT {i} AS k, * FROM ({spans(kind, patterns[kind], 'd')}) WHERE {valid[kind]}" for i, kind in enumerate(KINDS))
    term = lambda x: f"lower(regexp_replace({x}, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))"
    words = lambda x: f"string_split_regex({x}, '[\\x20\\x09-\\x0D]+')"
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED (SELECT *, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN {digits} ELSE lower(v) END AS entity FROM ({base})),
mentions AS (SELECT entity, list_filter(list_transform(l[greatest(1, len(l) - {WINDOW} + 1):len(l)] || r[1:{WINDOW}], lambda w: {term('w')}), lambda t: length(t) >= {MIN_TERM}) AS near
  FROM (SELECT entity, {words(f"rtrim(substr(text, 1, s), {space})")} AS l, {words(f"ltrim(substr(text, e + 1), {space})")} AS r FROM base)),
once AS (SELECT DISTINCT text FROM d),
total AS (SELECT sum(len({words('text')})) AS words FROM once),
contexts AS (SELECT DISTINCT entity, near FROM mentions),
known AS (SELECT entity, sum(len(near)) AS near_words FROM contexts GROUP BY 1 HAVING count(*) >= {MIN_CONTEXTS}),
pairs AS (SELECT entity, term, count(*) AS together FROM (SELECT entity, unnest(list_distinct(near)) AS term FROM contexts WHERE entity IN (SELECT entity FROM known)) GROUP BY 1, 2 HAVING count(*) >= {MIN_CONTEXTS}),
spoken AS (SELECT {term('w')} AS term, count(*) AS n FROM (SELECT unnest({words('text')}) AS w FROM once) GROUP BY 1),
told AS (SELECT entity, term FROM pairs JOIN known USING (entity) JOIN spoken USING (term) WHERE 1 + log2(least(together / n, 1)) / greatest(-log2(near_words / (SELECT words FROM total)), 1e-9) >= {DISCLOSURE}),
marked AS (SELECT DISTINCT doc_id, term FROM base JOIN told USING (entity)),
flagged AS (SELECT doc_id, text FROM d WHERE doc_id IN (SELECT doc_id FROM marked)),
extra AS (SELECT {len(KINDS)} AS k, w.doc_id, 'term' AS kind, s + length(regexp_extract(v, '^[^\\p{{L}}\\p{{N}}]*')) AS s, s + length(regexp_extract(v, '^[^\\p{{L}}\\p{{N}}]*')) + length(regexp_replace(v, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) AS e
  FROM ({spans('term', '[^\\x20\\x09-\\x0D]+', 'flagged')}) w JOIN marked m ON m.doc_id = w.doc_id AND m.term = {term('v')}),
every AS (SELECT k, doc_id, kind, s, e FROM base UNION ALL SELECT * FROM extra x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.e AND x.s < b.e)),
said AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)}, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (kind <> 'term'), '') AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS a FROM every GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN said USING (doc_id)
"""


@query("op9_pii", _sql())
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find personal data, and what discloses it, in every document."""
    found = find_personal(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))
