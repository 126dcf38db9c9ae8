"""Personal data: patterned identifiers, and terms that give their holders away.

The base kinds (email, ip, card, phone) are leftmost, non-overlapping matches of fixed patterns; matches that fail their
check are dropped. The sanitiser then looks at the corpus: an entity is one identifier value, a context is one line
(long lines are parted into stretches, so that a context holds a bounded number of pairs), and a term t discloses an
entity e as far as

    PMI(t; e) / IC(e) = 1 - log(n(t) / n(t, e)) / log(N / n(e))

reaches 1, which is when t occurs nowhere without e. Terms with a ratio of at least `threshold` and at least `support`
common contexts that are not copies of each other are spans of kind `term` in every document that holds the entity. All steps are DataFrame
expressions; documents without an identifier are not shuffled. Time is n to the 1.5 at most in the matches of one text.

Terms are learnt and looked up in lower case of all scripts; their offsets are those of the text as it stands.

Contract. Null text counts as empty. Offsets are code points, ends exclusive. Rows that share an id share the terms found
for it. Repeated lines count in n(.) and N as
often as they stand in the corpus, but give support only once. An empty table gives no rows. Extra columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, settled

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base kinds. Repeats are possessive and starts are pinned to a run's beginning (or the last
#: match's end), which leaves the matches as they are and the time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be worth the pattern.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: A word as it stands in the text, in any case.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A context: a line, or a stretch of a longer one, cut between its words (unless one has hundreds of characters).
STRETCH = r"[^\n]{1,1000}[^ \t\n]{0,300}"
#: Smallest disclosure ratio, and smallest number of distinct contexts that a term and an entity share.
THRESHOLD, SUPPORT = 0.8, 3
#: Candidate terms that may be broadcast to the scan that counts them; more are joined by shuffle.
MOST_TERMS = 200_000


def _valid(kind: str, m: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "ip":
        return f"forall(split({m}, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)"
    if kind == "phone":
        return f"length({digits}) BETWEEN 9 AND 15"
    if kind == "card":
        luhn = (
            f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + "
            f"CASE WHEN i % 2 = 1 THEN int(substr(reverse({digits}), i, 1)) "
            f"ELSE int(substr(reverse({digits}), i, 1)) * 2 - 9 * int(int(substr(reverse({digits}), i, 1)) > 4) END) % 10 = 0"
        )
        return f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {luhn} ELSE false END"
    return "true"


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'"


_SPAN = "s:int,k:int,e:int"
_NO_SPANS, _NO_BASE = f"cast(array() AS array<struct<{_SPAN},bs:int,be:int>>)", f"cast(array() AS array<struct<{_SPAN},m:string,bs:int,be:int>>)"
_LOW = "4294967295"


def _let(name: str, value: str, body: str) -> str:
    """SQL of the body with the value computed once under the name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _before(values: str, step: str) -> str:
    """SQL of an array: for each of the values (bigint), what the step (over x and y) makes of 0 and all values before it.

    Arrays grow by copying, so the fold runs over about sqrt(n) parts, and in each part over about sqrt(n) values."""
    fold = lambda over, start, made: f"aggregate({over}, named_struct('at', {start}, 'out', cast(array() AS array<bigint>)), (a, y) -> named_struct('at', {made}, 'out', concat(a.out, array(a.at))), a -> a.out)"
    plain = step.replace("x", "a.at")
    whole = f"aggregate(y, a.at, (x, z) -> {step.replace('y', 'z')})"
    parts = "transform(sequence(0, (size(vs) - 1) div width), i -> slice(vs, i * width + 1, width))"
    placed = f"flatten(zip_with(parts, {fold('parts', '0L', whole)}, (p, o) -> {fold('p', 'o', plain)}))"
    both = _let("width", "cast(ceil(sqrt(size(vs))) AS int)", _let("parts", parts, placed))
    return _let("vs", values, f"CASE WHEN size(vs) = 0 THEN cast(array() AS array<bigint>) ELSE {both} END")


def matches(text: str, pattern: str) -> str:
    """SQL of an array of structs s, e, m, bs, be: every match of the pattern in the column, in order, with its places in
    code points and in bytes.

    The matches and the gaps between them have the same lengths as the text, so running sums (both lengths in one number)
    place them.
    """
    found, gaps = f"regexp_extract_all({text}, {_sql(pattern)}, 0)", f"split({text}, {_sql(pattern)}, -1)"
    pairs = _let("ms", found, f"zip_with(ms, slice({gaps}, 1, size(ms)), (m, g) -> named_struct('m', m, 'n', length(m), 'b', octet_length(m), 'gn', length(g), 'gb', octet_length(g)))")
    starts = _before("transform(ps, x -> shiftleft(cast(x.gn + x.n AS bigint), 32) + x.gb + x.b)", "x + y")
    placed = (
        f"zip_with(ps, {starts}, (x, o) -> named_struct('s', cast(shiftright(o, 32) AS int) + x.gn, 'e', cast(shiftright(o, 32) AS int) + x.gn + x.n, 'm', x.m, "
        f"'bs', cast(o & {_LOW} AS int) + x.gb, 'be', cast(o & {_LOW} AS int) + x.gb + x.b))"
    )
    return _let("ps", pairs, placed)


def replaced(text: str, spans: str, by: str) -> str:
    """SQL of the text with its spans (sorted; with s, e, bs, be) replaced by the string `by`, an expression over the span
    x. Overlapping spans become one, named after the first. Pieces are cut by bytes, so that none is looked for."""
    reach = _before("transform(xs, x -> shiftleft(cast(x.e AS bigint), 32) + x.be)", "greatest(x, y)")
    kept = f"filter(zip_with(xs, {reach}, (x, o) -> named_struct('x', x, 'from', cast(o & {_LOW} AS int), 'free', x.s >= shiftright(o, 32))), q -> q.free)"
    pieces = f"transform({kept}, q -> concat(cast(substr(raw, q.from + 1, q.x.bs - q.from) AS string), {by.replace('x.', 'q.x.')}))"
    tail = "cast(substr(raw, array_max(transform(xs, x -> x.be)) + 1) AS string)"
    return _let("raw", f"cast({text} AS binary)", _let("xs", spans, f"CASE WHEN size(xs) = 0 THEN {text} ELSE concat(array_join({pieces}, ''), {tail}) END"))


def base_spans(docs: DataFrame, text: str = "text", into: str = "base") -> DataFrame:
    """docs with an array of structs s, k (place of the kind in KINDS), e, m, bs, be: the base kinds' spans by start and kind."""
    parts = []
    for k, kind in enumerate(KINDS):
        spans = f"transform(filter({matches('__t', PATTERNS[kind])}, x -> {_valid(kind, 'x.m')}), x -> named_struct('s', x.s, 'k', {k}, 'e', x.e, 'm', x.m, 'bs', x.bs, 'be', x.be))"
        parts.append(f"CASE WHEN __t RLIKE {_sql(HINTS[kind])} THEN {spans} ELSE {_NO_BASE} END")
    df = docs.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    return df.withColumn(into, F.expr(f"array_sort(concat({', '.join(parts)}))")).drop("__t")


def hinted(text: Column) -> Column:
    """Whether the text may hold any base kind."""
    return F.coalesce(text.rlike("|".join(HINTS.values())), F.lit(False))


def _entity(x: Column) -> Column:
    return F.concat_ws(":", x["k"].cast("string"), F.translate(x["m"], UPPER, LOWER))


def _folded(x: Column) -> Column:
    """The one form in which terms are learnt and looked up: lower case of all scripts. Lower case of a capital sigma
    depends on its neighbours, so both small forms count as one; a word then folds alone as it does inside its text."""
    return F.replace(F.lower(x), F.lit("ς"), F.lit("σ"))


def disclosing_terms(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """(entity, terms): the terms that disclose each entity, from all documents."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    stretches = F.regexp_extract_all(body, F.lit(STRETCH), F.lit(0))
    lines = docs.where(hinted(body)).select(F.explode(stretches).alias("line")).where(hinted(F.col("line")))
    lines = base_spans(lines.groupBy("line").agg(F.count("*").alias("copies")), "line").where(F.size("base") > 0)
    # the words of a line without its spans, which are no terms themselves
    words = F.array_distinct(F.regexp_extract_all(_folded(F.expr(replaced("line", "base", "' '"))), F.lit(WORD), F.lit(0)))
    lines = settled(lines.select(F.md5("line").alias("id"), "copies", F.array_distinct(F.transform("base", _entity)).alias("entities"), F.filter(words, lambda w: F.length(w) > 1).alias("words")))
    held = lines.select("id", "copies", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("contexts")).where(F.col("contexts") >= support)
    pairs = held.join(entities, "entity").select("id", "entity", "n_e", "copies").join(lines.select("id", "words"), "id").select("entity", "n_e", "copies", F.explode("words").alias("term"))
    pairs = pairs.groupBy("entity", "n_e", "term").agg(F.sum("copies").alias("n_te"), F.count("*").alias("contexts"))
    pairs = settled(pairs.where(F.col("contexts") >= support))
    if pairs.isEmpty():
        return pairs.select("entity", F.array("term").alias("terms"))
    terms = settled(pairs.select("term").distinct())
    if terms.count() <= MOST_TERMS:
        terms = F.broadcast(terms)
    n = docs.agg(F.sum(F.regexp_count(body, F.lit(STRETCH)))).first()[0]
    spoken = docs.select(F.explode(stretches).alias("line")).select(F.explode(F.array_distinct(F.regexp_extract_all(_folded(F.col("line")), F.lit(WORD), F.lit(0)))).alias("term"))
    counts = spoken.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    ratio = 1 - F.log2(F.greatest(F.col("n_t") / F.col("n_te"), F.lit(1.0))) / F.log2(F.lit(float(n + 1)) / F.col("n_e"))
    return pairs.join(counts, "term").where(ratio >= threshold).groupBy("entity").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """docs with `base`, and `spans`: an array of structs s, k, e, bs, be of all spans (k = 4: a disclosing term; bs and
    be in bytes). Only documents with an identifier are shuffled."""
    disclosed = settled(disclosing_terms(docs, text, threshold, support))
    body = F.col(text).cast("string")
    some, none = base_spans(docs.where(hinted(body)), text), docs.where(~hinted(body)).withColumns({"base": F.expr(_NO_BASE), "spans": F.expr(_NO_SPANS)})
    bare = "transform(base, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'bs', x.bs, 'be', x.be))"
    if disclosed.isEmpty():
        return some.withColumn("spans", F.expr(bare)).unionByName(none)
    holders = some.select(F.col(key).alias("__key"), F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    by_doc = holders.distinct().join(disclosed, "entity").select("__key", F.explode("terms").alias("term")).groupBy("__key").agg(F.collect_set("term").alias("__terms"))
    joined = some.join(by_doc, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    joined = joined.withColumn("__t", F.when(F.col("__terms").isNotNull(), body))
    # base spans are ASCII: with spaces for them, every other place of the text stays; a word that changes overlaps one
    spaced = f"cast({replaced('__t', 'base', "repeat(' ', x.e - x.s)")} AS binary)"
    words = f"filter({matches('h.m', ANY_WORD)}, x -> array_contains(__terms, replace(lower(x.m), 'ς', 'σ')) AND substr(spaced, h.bs + x.bs + 1, x.be - x.bs) = cast(x.m AS binary))"
    placed = f"transform({words}, x -> named_struct('s', h.s + x.s, 'k', 4, 'e', h.s + x.e, 'bs', h.bs + x.bs, 'be', h.bs + x.be))"
    found = f"flatten(transform(filter({matches('__t', STRETCH)}, h -> exists(__terms, w -> contains(replace(lower(h.m), 'ς', 'σ'), w))), h -> {placed}))"
    terms = f"CASE WHEN __terms IS NULL THEN {_NO_SPANS} ELSE {_let('spaced', spaced, found)} END"
    return joined.withColumn("spans", F.expr(f"array_sort(concat({bare}, {terms}))")).drop("__terms", "__t").unionByName(none)


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """docs, same columns: identifiers generalised to their kind in brackets, disclosing terms to [TERM]. Overlapping
    spans become one, named after the first."""
    rest = [c for c in docs.columns if c not in (key, text)]  # out of the way of the names used here
    packed = docs.select(key, text, *([F.struct(*rest).alias("__rest")] if rest else []))
    found = find(packed, key, text, threshold, support)
    names = "array('[EMAIL]', '[IP]', '[CARD]', '[PHONE]', '[TERM]')"
    body = replaced(f"`{text}`", "spans", f"element_at({names}, x.k + 1)")
    done = found.withColumn(text, F.when(F.size("spans") > 0, F.expr(body)).otherwise(F.col(text)))
    return done.select(*[F.col(c) if c in (key, text) else F.col(f"__rest.`{c}`").alias(c) for c in docs.columns])


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest of find(): counts of the base kinds, the SHA-256 of their spans, and all spans."""
    names = F.array(*map(F.lit, (*KINDS, "term")))

    def joined(column: str) -> Column:
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")

    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) AS bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(key, *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
