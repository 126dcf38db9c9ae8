"""Scores of answers, formats and log-probabilities, over columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .text import answer_key, answer_of, blank, c, last_boxed, latex_normalised


def exact_match(answer: Column | str, golds: Column | str) -> Column:
    return F.exists(c(golds), lambda g: answer_key(g) == answer_key(answer)).cast("double")


def contains_match(answer: Column | str, golds: Column | str) -> Column:
    return F.exists(c(golds), lambda g: answer_key(answer).contains(answer_key(g))).cast("double")


def _counts(words: Column) -> Column:
    return F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("w"), F.size(F.filter(words, lambda x: x == w)).alias("n")))


def answer_counts(text: Column | str) -> Column:
    """The words of an answer after normalisation, with their numbers: a map, to be made once for each text."""
    held = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # noqa: E731 (a lambda's body is evaluated for each element: x once, as its variable)

    def counted(words: Column) -> Column:
        # sorted words: each stretch of equal ones begins where the word before differs
        firsts = F.filter(F.sequence(F.lit(1), F.size(words) + 1), lambda i: (i > F.size(words)) | (i == 1) | (F.get(words, i - 1) != F.get(words, F.greatest(i - 2, F.lit(0)))))
        return held(firsts, lambda at: F.transform(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda i, k: F.struct(F.get(words, i - 1).alias("w"), (F.get(at, k + 1) - i).alias("n"))))

    return F.map_from_entries(held(F.array_sort(F.filter(F.split(answer_key(text), " "), lambda w: w != "")), counted))


def f1_of_counts(answer: Column | str, gold: Column | str) -> Column:
    """F1 of two maps of answer_counts; two empty answers agree."""
    a, b = c(answer), c(gold)
    common = F.aggregate(F.array_intersect(F.map_keys(a), F.map_keys(b)), F.lit(0), lambda s, w: s + F.least(a[w], b[w]))
    size = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda s, n: s + n)
    total = size(a) + size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * common / total)


def token_f1(answer: Column | str, golds: Column | str) -> Column:
    """Best F1 of common words, with multiplicity, over the golds; two empty answers agree."""
    words = lambda x: F.filter(F.split(answer_key(x), " "), lambda w: w != "")
    mine = words(answer)

    def one(gold: Column) -> Column:
        theirs = words(gold)
        common = F.aggregate(_counts(mine), F.lit(0), lambda s, x: s + F.least(x["n"], F.size(F.filter(theirs, lambda w: w == x["w"]))))
        total = F.size(mine) + F.size(theirs)
        return F.when(total == 0, 1.0).otherwise(2.0 * common / total)

    return F.coalesce(F.array_max(F.transform(c(golds), one)), F.lit(0.0))


_CALL = r"(?s)^\s*<think>.*?</think>\s*<tool_call>.*?</tool_call>\s*$"
_LAST = r"(?s)^\s*<think>.*?</think>\s*<answer>.*?</answer>\s*$"


def format_score(blocks: Column | str) -> Column:
    """Half a point for every block but the last that thinks and calls, and for a last one that thinks and answers."""
    b = c(blocks)
    calls = F.size(F.filter(F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))), lambda x: x.rlike(_CALL)))
    last = F.when((F.size(b) > 0) & F.coalesce(F.try_element_at(b, F.lit(-1)).rlike(_LAST), F.lit(False)), 0.5).otherwise(0.0)
    return calls * 0.5 + last


def format_reward(blocks: Column | str, golds: Column | str) -> Column:
    """-1, the format score up to 1, and, only if that is full, the answer's F1."""
    f = F.least(format_score(blocks), F.lit(1.0))
    answer = F.coalesce(token_f1(answer_of(F.try_element_at(c(blocks), F.lit(-1))), golds), F.lit(0.0))
    return F.when(f == 1.0, -1.0 + f + answer).otherwise(-1.0 + f)


def last_number(x: Column | str) -> Column:
    return F.try_element_at(F.regexp_extract_all(F.replace(c(x), F.lit(","), F.lit("")), F.lit(r"-?\d+\.?\d*"), F.lit(0)), F.lit(-1))


def number_match(x: Column | str, truth: Column | str) -> Column:
    return F.coalesce(last_number(x).try_cast("double") == F.replace(c(truth), F.lit(","), F.lit("")).try_cast("double"), F.lit(False)).cast("double")


def boxed_match(x: Column | str, truth: Column | str) -> Column:
    return F.coalesce(latex_normalised(last_boxed(c(x))) == latex_normalised(c(truth)), F.lit(False)).cast("double")


def lines_match(x: Column | str, y: Column | str) -> Column:
    """Outputs equal once trimmed, or line by line once every line is."""
    lines = lambda v: F.transform(F.split(F.trim(c(v)), "\n"), lambda v: F.trim(v))
    return (F.trim(c(x)) == F.trim(c(y))) | (lines(x) == lines(y))


#: Score functions by data source: (answer text, golds) -> column.
SCORERS = {"em": exact_match, "sub_em": contains_match, "f1": token_f1}


def score_by(metric: str, answer: Column | str, golds: Column | str) -> Column:
    if metric not in SCORERS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(sorted(SCORERS))}")
    return SCORERS[metric](answer, golds)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def kl(kind: str, logprob: Column | str, reference: Column | str) -> Column:
    d = c(logprob) - c(reference)
    kinds = {"kl": d, "abs": F.abs(d), "mse": 0.5 * d * d, "low_var_kl": clip(F.exp(-d) + d - 1, -10.0, 10.0)}
    if kind not in kinds:
        raise ValueError(f"unknown penalty {kind!r}")
    return kinds[kind]


def next_beta(beta: float, current: float, target: float, steps: int, horizon: int) -> float:
    """The adaptive controller's next coefficient."""
    return beta * (1 + max(-0.2, min(0.2, current / target - 1)) * steps / horizon)


def entropy(logits: Column | str) -> Column:
    """Entropy of a row of logits."""
    v = c(logits)
    top = F.array_max(v)
    z = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.log(z) + top - F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top) * x) / z


def log_prob(logits: Column | str, label: Column | str) -> Column:
    """Log-softmax of the label (from 0)."""
    v = c(logits)
    top = F.array_max(v)
    return F.element_at(v, c(label) + 1) - top - F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def eos_mask(ids: Column | str, eos: int) -> Column:
    """1 up to and with the first end token."""
    at = F.array_position(c(ids), eos)
    return F.transform(c(ids), lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def position_ids(mask: Column | str) -> Column:
    """Positions that count masked-in tokens from 0, 0 elsewhere."""
    m = c(mask)
    return F.transform(m, lambda x, i: F.when(x == 1, F.aggregate(F.slice(m, 1, i + 1), F.lit(0), lambda s, y: s + y) - 1).otherwise(0))


def padded(ids: Column | str, n: int, pad: int, left: bool = False, truncation: str = "right") -> Column:
    """Exactly n ids: padded on one side, cut on one side, or an error if longer."""
    v = c(ids)
    if truncation == "error":
        v = F.when(F.size(v) > n, F.raise_error(F.lit(f"more than {n} ids"))).otherwise(v)
    cut = F.when(F.size(v) > n, F.slice(v, 1, n) if truncation != "left" else F.slice(v, -n, n)).otherwise(v)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(cut), F.lit(0)))
    return F.concat(fill, cut) if left else F.concat(cut, fill)


def sft_row(prompt: Column | str, response: Column | str, n: int, pad: int) -> Column:
    """struct(ids, mask, loss_mask) of a prompt and its response in n places; the loss leaves out the prompt but its
    last place, and the last token."""
    p, r = c(prompt), c(response)
    size = F.least(F.size(p) + F.size(r), F.lit(n))
    places = F.sequence(F.lit(0), F.lit(n - 1))
    loss = F.transform(places, lambda i: F.when((i >= F.size(p) - 1) & (i < size - 1), 1).otherwise(0))
    return F.struct(padded(F.concat(p, r), n, pad).alias("ids"), F.transform(places, lambda i: (i < size).cast("int")).alias("mask"), loss.alias("loss_mask"))


def masked_spans(x: Column | str, tags: list[str]) -> Column:
    """Character spans [start, stop) from the i-th opening to the i-th closing of every tag, in order. A closing before
    its opening gives a span that covers nothing (stop <= start); openings or closings without a partner give none."""

    @pandas_udf("array<struct<start:int,stop:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            pairs = (zip(re.finditer(f"<{re.escape(t)}>", text), re.finditer(f"</{re.escape(t)}>", text)) for t in tags)
            return [{"start": a, "stop": b} for a, b in sorted((a.start(), b.end()) for found in pairs for a, b in found)]

        return pd.Series([one(t) for t in texts], dtype=object)

    return spans(c(x))


def tool_call(x: Column | str) -> Column:
    """struct(tool, args) of the first call; a list gives its first; an old-style query becomes a search; else INVALID."""
    body = F.regexp_replace(F.regexp_extract(c(x), r"(?s)<tool_call>(.*?)</tool_call>", 1), r"\\n|\\t", "")
    first = F.coalesce(F.get_json_object(body, "$[0]"), F.when(F.get_json_object(body, "$.tool").isNotNull(), body))
    tool = F.get_json_object(first, "$.tool")
    old = F.trim(F.regexp_extract(c(x), r"(?s)<query>(.*?)</query>", 1))
    args = F.from_json(F.get_json_object(first, "$.args"), "map<string,string>")
    return F.when(tool.isNotNull(), F.struct(tool.alias("tool"), args.alias("args"))).when(~blank(old), F.struct(F.lit("search").alias("tool"), F.create_map(F.lit("query"), old).alias("args"))).otherwise(
        F.struct(F.lit("INVALID").alias("tool"), F.create_map().cast("map<string,string>").alias("args"))
    )


def tool_succeeded(x: Column | str) -> Column:
    """Success of a tool's answer: its JSON flag, or, without JSON, no word of failure."""
    flag = F.get_json_object(c(x), "$.success")
    return F.when(flag.isNotNull(), flag == "true").otherwise(~F.lower(c(x)).rlike("error|fail|invalid"))


def public_args(args: Column | str) -> Column:
    return F.map_filter(c(args), lambda k, v: (k != "knowledge") & ~k.startswith("__"))


def kept_args(args: Column | str, names: list[str]) -> Column:
    return F.map_filter(c(args), lambda k, v: k.isin(names))


def args_violation(args: Column | str, required: list[str], numbers: list[str] = ()) -> Column:
    """The first fault of a call's arguments; null if there is none. Unknown names pass."""
    faults = [F.when(c(args).isNull(), "not a map")]
    faults += [F.when(~F.map_contains_key(c(args), name), f"missing {name}") for name in required]
    faults += [F.when(F.try_element_at(c(args), F.lit(n)).isNotNull() & ~F.try_element_at(c(args), F.lit(n)).rlike(r"^-?[0-9.]+$|^true$|^false$"), f"{n} is no number") for n in numbers]
    return F.coalesce(*faults)


def flops(lengths: DataFrame, length: str, per_token: float, per_square: float) -> DataFrame:
    """Closed-form estimate from sequence lengths."""
    return lengths.agg(F.sum(length).alias("tokens"), F.sum(F.col(length).cast("double") * F.col(length)).alias("squares")).withColumn("flops", F.col("tokens") * per_token + F.col("squares") * per_square)


def until_first_call(x: Column | str) -> Column:
    """The text up to and with its first closed tool call; the whole without one."""
    return F.when(c(x).contains("</tool_call>"), F.concat(F.substring_index(c(x), "</tool_call>", 1), F.lit("</tool_call>"))).otherwise(c(x))


def runs_replaced(ids: Column | str, token: int, by: list[int]) -> Column:
    """Every run of a token in an id array as one fixed sequence."""
    v = c(ids)
    starts = F.transform(v, lambda x, i: F.when(x != token, F.array(x)).when((i == 0) | (F.element_at(v, F.greatest(i, F.lit(1))) != token), F.array(*map(F.lit, by))).otherwise(F.array().cast("array<int>")))
    return F.flatten(starts)
