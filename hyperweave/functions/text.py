"""Text functions over columns."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK, SEP = "<hyperedge>", "<SEP>"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x: Column | str) -> Column:
    """Trimmed, runs of white space as one space."""
    return F.regexp_replace(F.trim(F.regexp_replace(c(x), r"\s+", " ")), "^ +| +$", "")


def blank(x: Column | str) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(c(x), r"\s+", " ")), F.lit("")) == ""


def first_present(*xs: Column | str) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(F.when(~blank(x), c(x)) for x in xs))


def truthy(x: Column | str, default: bool = False) -> Column:
    v = F.lower(F.trim(c(x).cast("string")))
    return F.when(v.isNull(), F.lit(default)).otherwise(v.isin("1", "true", "yes", "y"))


def number_or(x: Column | str, default: float) -> Column:
    """The value as a double, or the default where it is none."""
    return F.coalesce(c(x).try_cast("double"), F.lit(float(default)))


def is_number(x: Column | str) -> Column:
    """Digits with an optional sign and point, no exponent."""
    return c(x).rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def md5_id(prefix: str, x: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.md5(c(x).cast("string").cast("binary")))


def document_id(x: Column | str) -> Column:
    return md5_id("doc-", F.trim(c(x)))


@F.pandas_udf(T.StringType())
def _unescape(values):
    return values.map(lambda v: html.unescape(v) if v is not None else None)


def clean(x: Column | str, entities: bool = True) -> Column:
    """Trimmed, HTML entities resolved, control characters dropped."""
    v = F.trim(c(x))
    v = F.when(v.contains("&"), _unescape(F.when(v.contains("&"), v))).otherwise(v) if entities else v
    return F.regexp_replace(v, r"[\x00-\x1f\x7f-\x9f]", "")


def split_on(x: Column | str, markers: list[str]) -> Column:
    """Trimmed parts between any of the markers, blanks dropped; without markers the whole."""
    if not markers:
        return F.array(c(x))
    pattern = "|".join(r"\Q" + m + r"\E" for m in markers)
    return F.filter(F.transform(F.split(c(x), pattern), lambda v: F.trim(v)), lambda p: p != "")


def json_body(x: Column | str) -> Column:
    """The outermost braces of a text, with single quotes made double."""
    return F.nullif(F.replace(F.regexp_extract(c(x), r"(?s)\{.*\}", 0), F.lit("'"), F.lit('"')), F.lit(""))


def hyperedge_text(x: Column | str) -> Column:
    """A hyperedge's name without its marker and the quotes around it."""
    v = F.regexp_replace(F.trim(c(x)), "^" + MARK, "")
    return F.trim(F.regexp_replace(F.trim(v), '^"(.*)"$', "$1"))


def hyperedge_name(x: Column | str) -> Column:
    return F.concat(F.lit(MARK + '"'), hyperedge_text(x), F.lit('"'))


def query_key(x: Column | str) -> Column:
    """Lower case, white space collapsed: what caches and lookups are keyed by."""
    return F.lower(collapse(x))


def dataset_name(x: Column | str) -> Column:
    return F.btrim(F.regexp_replace(c(x), r"[^A-Za-z0-9_.-]", "_"), F.lit("._-"))


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def answer_key(x: Column | str) -> Column:
    """Answers as they are compared: lower case, no ASCII punctuation, no articles, white space collapsed."""
    v = F.translate(F.lower(c(x)), PUNCTUATION, "")
    return collapse(F.regexp_replace(v, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " "))


def answer_of(x: Column | str) -> Column:
    """What stands in the first answer tags; null without them."""
    return F.when(c(x).rlike(r"(?s)<answer>.*?</answer>"), F.trim(F.regexp_extract(c(x), r"(?s)<answer>(.*?)</answer>", 1)))


#: The placeholders that stand for images in a prompt.
VISION = ["<|vision_start|>", "<|vision_end|>", "<|image_pad|>", "<|video_pad|>"]


def without_vision(x: Column | str) -> Column:
    v = c(x)
    for token in VISION:
        v = F.replace(v, F.lit(token), F.lit(""))
    return F.trim(v)


def assistant_blocks(x: Column | str) -> Column:
    """The texts of all assistant turns of a chat rendered with turn markers."""
    return F.regexp_extract_all(c(x), F.lit(r"(?s)<\|im_start\|>assistant\n(.*?)<\|im_end\|>"), F.lit(1))


def answer_parts(x: Column | str) -> Column:
    """Alternatives, parted by | and then &&, trimmed, each once."""
    parts = F.flatten(F.transform(F.split(c(x), r"\|"), lambda p: F.split(p, "&&")))
    return F.array_distinct(F.filter(F.transform(parts, lambda v: F.trim(v)), lambda p: p != ""))


def image_ids(x: Column | str) -> Column:
    """Ids of a JSON array, or of a list parted by , ; | or white space."""
    listed = F.from_json(c(x), "array<string>")
    parted = F.split(c(x), r"[,;|\s]+")
    return F.filter(F.when(F.trim(c(x)).startswith("["), listed).otherwise(parted), lambda p: F.trim(p) != "")


def image_source(x: Column | str) -> Column:
    v = F.trim(c(x))
    return F.when(v.rlike("^[0-9]+$"), "inaturalist").when(v.rlike("^[0-9a-f]{16}$"), "gldv2").when(v.startswith("oven_"), "oven").otherwise("unknown")


def summary(x: Column | str, n: int) -> Column:
    v = collapse(x)
    return F.when(F.length(v) > n, F.concat(F.rtrim(F.substring(v, 1, n - 3)), F.lit("..."))).otherwise(v)


def preview(x: Column | str, n: int = 200) -> Column:
    return F.when(F.length(c(x)) > n, F.concat(F.substring(c(x), 1, n - 3), F.lit("..."))).otherwise(c(x))


def description(x: Column | str) -> Column:
    """The text without its first two lines that are not blank, as one line."""
    lines = F.filter(F.transform(F.split(c(x), "\n"), lambda v: F.trim(v)), lambda p: p != "")
    return F.when(F.size(lines) > 2, F.array_join(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))), " ")).otherwise("")


def compact(x: Column | str) -> Column:
    """Lower case, anything but letters, digits and _ as a space: what answers are looked for in."""
    return F.trim(F.regexp_replace(F.lower(c(x)), r"[^\p{L}\p{N}_]+", " "))


def entity_label(*xs: Column | str) -> Column:
    """The first value that is neither blank nor a link, in capitals; UNKNOWN without one."""
    return F.upper(F.coalesce(*(F.when(~blank(x) & ~F.trim(c(x)).rlike("(?i)^https?://"), F.trim(c(x))) for x in xs), F.lit("UNKNOWN")))


def safe_id(x: Column | str) -> Column:
    return F.coalesce(c(x).rlike(r"^[A-Za-z0-9_.-]+$") & ~c(x).isin(".", ".."), F.lit(False))


def safe_path(x: Column | str) -> Column:
    v = F.replace(c(x), F.lit("\\"), F.lit("/"))
    return F.coalesce(~blank(v) & ~v.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)"), F.lit(False))


def portable_path(x: Column | str, root: str = "datasets_mm/") -> Column:
    """Forward slashes, cut from the data root on, if it is there."""
    v = F.replace(c(x), F.lit("\\"), F.lit("/"))
    return F.when(F.instr(v, root) > 0, v.substr(F.instr(v, root), F.length(v))).otherwise(v)


def search_lines(x: Column | str, n: int = 5) -> Column:
    """Titles with descriptions of a numbered result text, at most n, as lines."""
    titles = F.regexp_extract_all(c(x), F.lit(r"\[\d+\] Title: *([^\n]*)"), F.lit(1))
    bodies = F.regexp_extract_all(c(x), F.lit(r"\[\d+\] Title: *[^\n]*\n(?:Description: *([^\n]*))?"), F.lit(1))
    lines = F.zip_with(titles, bodies, lambda t, b: F.when(blank(b), t).otherwise(F.concat(t, F.lit(": "), b)))
    return F.array_join(F.slice(F.filter(lines, lambda v: F.trim(v) != ""), 1, n), "\n")


def field_hint(name: Column | str, hints: list[str]) -> Column:
    key = F.regexp_replace(F.lower(c(name)), "[^a-z0-9]", "")
    return F.exists(F.array(*map(F.lit, hints)), lambda h: key.contains(h))


def tool_name(x: Column | str, aliases: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(v) for p in aliases.items() for v in p)) if aliases else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(c(x)))), c(x))


def packed_messages(x: Column | str) -> Column:
    """Texts as alternating user and assistant messages."""
    return F.transform(c(x), lambda t, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), t.alias("content")))


def wrong_call(x: Column | str, tools: list[str]) -> Column:
    """Why a tool call is malformed; null if it is not. The first reason counts."""
    inside = F.regexp_extract(c(x), r"(?s)<tool_call>(.*?)</tool_call>", 1)
    name = F.get_json_object(inside, "$.tool")
    return (
        F.when(c(x).contains("<query>") & ~c(x).contains("<tool_call>"), "old format")
        .when(~c(x).contains("<tool_call>"), "no tags")
        .when(~c(x).contains("</tool_call>"), "not closed")
        .when(F.try_parse_json(inside).isNull(), "bad JSON")
        .when(name.isNull(), "no tool")
        .when(~name.isin(tools), "unknown tool")
    )


def token_chunks(docs: DataFrame, key: str, text: str, most: int = 768, overlap: int = 64) -> DataFrame:
    """(key, chunk_order_index, tokens, content): windows of `most` tokens that start every most - overlap tokens. The
    last may hold nothing but overlap. Tokens are words between white space; `tokens` has windows of a vocabulary's tokens."""
    step = most - overlap
    words = docs.select(key, F.filter(F.split(c(text), r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    starts = words.select(key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("s"))
    return starts.select(
        key,
        (F.col("s") / step).cast("int").alias("chunk_order_index"),
        F.least(F.lit(most), F.size("w") - F.col("s")).alias("tokens"),
        F.array_join(F.slice("w", F.col("s") + 1, most), " ").alias("content"),
    )


@F.pandas_udf(T.StringType())
def unicode_unescape(values):
    """\\uXXXX escapes as their characters."""
    import re

    return values.map(lambda v: re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), v) if v is not None else None)


@F.pandas_udf(T.StringType())
def latex_normalised(values):
    """Fractions, roots, units and spacing of short mathematical answers in one form."""
    import re

    def one(v):
        if v is None:
            return None
        v = v.replace("\n", "").replace("\\!", "").replace("\\\\", "\\").replace("\\ ", "").replace("tfrac", "frac").replace("dfrac", "frac").replace("\\left", "").replace("\\right", "")
        v = v.replace("^{\\circ}", "").replace("^\\circ", "").replace("\\$", "").replace("\\%", "").replace("%", "")
        v = re.sub(r"\\text\{ .*?\}$", "", v)
        v = v.replace(" .", " 0.").replace("{.", "{0.")
        v = re.sub(r"^\s*\.", "0.", v)
        # an equation's short left side goes
        v = re.sub(r"^([^=]{0,2})=(?=[^=]*$)", "", v)
        v = re.sub(r"\\sqrt([^{\s])", r"\\sqrt{\1}", v)
        v = re.sub(r"\\frac([^{\s])([^{\s])", r"\\frac{\1}{\2}", v)
        v = re.sub(r"\\frac\{([^{}]*)\}([^{\s])", r"\\frac{\1}{\2}", v)
        v = re.sub(r"^(-?\d+)/(\d+)$", r"\\frac{\1}{\2}", v.replace(" ", ""))
        return "\\frac{1}{2}" if v == "0.5" else v

    return values.map(one)


@F.pandas_udf(T.StringType())
def last_boxed(values):
    """What stands in the last \\boxed{...}, braces balanced; null without one."""

    def one(v):
        at = v.rfind("\\boxed{") if v is not None else -1
        if at < 0:
            return None
        depth, start = 0, at + 7
        for k in range(start, len(v)):
            if v[k] == "{":
                depth += 1
            elif v[k] == "}":
                if not depth:
                    return v[start:k]
                depth -= 1
        return None

    return values.map(one)
