"""Column functions over texts: normalisation, validation, keywords, injection, verdicts.  All run in the JVM but NFKC."""

import string
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sluice.functions import fixed as K

SPACE = r"(?U)\s+"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it; keeps plans small.  No Python UDFs in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_match(text: Column, patterns: list[str], flags: str = "(?iuU)") -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(flags + p)
    return out


# -- normalisation


def strip_invisible(text: Column) -> Column:
    return F.translate(text, "".join(map(chr, K.INVISIBLE)), "")


def _nfkc(text: Column) -> Column:
    def change(text: pd.Series) -> pd.Series:
        return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    return F.pandas_udf(change, StringType())(text)


def nfkc(text: Column) -> Column:
    """NFKC; ASCII is its own normal form, so only other texts change."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, _nfkc(F.when(other, text))).otherwise(text)  # the worker gets nulls for the rest


def _rebuild(text: Column, pattern: str, change) -> Column:
    """text with change applied to every match of pattern: gaps and matches in turn."""

    def body(t):
        gaps = F.split(t, pattern, -1)
        hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        pairs = F.zip_with(gaps, F.transform(hits, change), lambda g, h: F.concat(g, F.coalesce(h, F.lit(""))))
        return F.when(t.rlike(pattern), F.concat_ws("", pairs)).otherwise(t)

    return let(text, body)


def strip_separators(text: Column) -> Column:
    """Letters set apart by dots, dashes or spaces, three at least, come together: H.o.w becomes How."""
    pattern = r"(?U)(?<!\w)[a-zA-Z](?:[.\-\s][a-zA-Z]){2,}(?!\w)"
    return _rebuild(text, pattern, lambda m: F.regexp_replace(m, r"[.\- ]", ""))


def expand_leet(text: Column) -> Column:
    """Look-alike characters inside tokens that are otherwise letters: k1ll becomes kill."""
    edge = "".join("\\" + c if c in "$+" else c for c in K.LEET_EDGE)
    leet = "".join("\\" + c if c in "$+" else c for c in K.LEET)

    def change(token: Column) -> Column:
        return F.when(token.rlike(f"[{leet}]"), let(token, expand)).otherwise(token)

    def expand(token: Column) -> Column:
        head = F.regexp_extract(token, f"^[{edge}]*", 0)
        core = F.regexp_replace(token, f"^[{edge}]+|[{edge}]+$", "")
        tail = F.substr(token, F.length(head) + F.length(core) + 1)
        word = core.rlike(rf"^[\p{{L}}{leet}]+$") & core.rlike(r"\p{L}") & core.rlike(f"[{leet}]")
        return F.when(word, F.concat(head, F.translate(core, "".join(K.LEET), "".join(K.LEET.values())), tail)).otherwise(token)

    return _rebuild(text, r"(?U)\S+", change)


def collapse_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACE, " "))


def normalize(text: Column) -> Column:
    """Invisible characters out, NFKC, separators out, look-alikes expanded, white space collapsed."""
    return after_nfkc(nfkc(strip_invisible(text)))


def after_nfkc(text: Column) -> Column:
    """The steps of normalize that follow NFKC; all of them run in the JVM."""
    return collapse_space(expand_leet(strip_separators(text)))


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def resolve_category(name: Column) -> Column:
    """An alias to its code; anything else in capitals."""
    return F.coalesce(_map(K.CATEGORY_ALIASES)[F.translate(F.lower(name), "- ", "__")], F.upper(name))


def output_gate(gate: Column) -> Column:
    pairs = {"input": "output", "prompt": "output", "tool_input": "tool_output", "retrieval_query": "retrieval_result"}
    return F.coalesce(_map(pairs)[gate], F.lit("output"))


# -- validation


def top_word_count(text: Column) -> Column:
    """Count of the most frequent word, of sorted words by run length."""
    # lowered word by word: only words beyond ASCII take the slow case mapping
    words = F.array_sort(F.transform(F.split(strip(text), SPACE), F.lower))
    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc, w):
        run = F.when(acc["word"].eqNullSafe(w), acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("word"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(words, start, step, lambda acc: acc["most"])


def validation_reason(text: Column, max_chars: int = K.MAX_CHARS, max_repeat: int = K.MAX_CHAR_REPEAT, max_ratio: float = K.MAX_WORD_RATIO, check_repeat: Column | None = None) -> Column:
    """The first of input_too_long, empty_input, char_repetition, word_repetition that holds, or null."""
    flood = text.rlike("(?d)(.)\\1{%d,}" % (max_repeat - 1)) if max_repeat > 0 else F.lit(False)
    if check_repeat is not None:
        flood = flood & check_repeat
    total = F.size(F.split(strip(text), SPACE))
    repeated = (total >= K.MIN_WORDS) & (top_word_count(text) / total > F.lit(max_ratio)) if max_ratio < 1 else F.lit(False)
    empty = ~text.rlike(r"(?U)\S")
    return F.when(F.length(text) > max_chars, "input_too_long").when(empty, "empty_input").when(flood, "char_repetition").when(repeated, "word_repetition")


# -- keywords


def keyword_match(text: Column) -> Column:
    """struct(pattern, category) of the first keyword pattern unless an exclusion holds; null without one."""
    chain = None
    for p, c in K.KEYWORDS:
        hit, value = text.rlike("(?iusU)" + p), F.struct(F.lit(p).alias("pattern"), F.lit(c).alias("category"))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    # exclusions are looked for only where a pattern holds
    return let(chain, lambda m: F.when(m.isNotNull() & ~any_match(text, K.KEYWORD_EXCLUSIONS, "(?iuUd)"), m))


# -- injection

#: For each injection pattern in turn, ASCII words of which any match holds one; a text without them needs no regular
#: expression.
NEEDLES = [
    ("ignore",),
    ("disregard",),
    ("forget",),
    ("override",),
    ("ignore", "disregard", "forget"),
    ("anything",),
    ("dan",),
    ("without", "uncensored", "unfiltered"),
    ("pretend",),
    ("unrestricted", "without", "unfiltered"),
    ("role", "pretend", "imagine"),
    ("hypothetical", "fictional", "imaginary", "story"),
    ("<|system|>",),
    ("<|im_start|>",),
    ("[system]",),
    ("###",),
    ("###",),
    ("<<sys>>",),
    ("dan",),
    ("dan",),
    ("dan", "stan", "dude", "jailbroken", "unrestricted", "developer"),
    ("rule", "restriction", "limit", "guideline", "filter"),
    ("mode",),
    ("mode",),
    ("prompt", "instruction"),
    ("your",),
    ("read", "process", "see"),
    ("follow", "obey", "execute", "perform"),
    ("jailbreak", "bypass", "circumvent", "neutralize", "disable"),
    ("unlock", "remove", "disable"),
    ("---", "===", "___"),
]


def fold(text: Column) -> Column:
    """Every character that a pattern takes for an ASCII letter, case aside, as that letter in lower case."""
    return F.translate(text, string.ascii_uppercase + "\u0130\u0131\u017f\u212a", string.ascii_lowercase + "iisk")


def injection_found(text: Column, low: Column, min_severity: str = "low", extra: list[tuple[str, str, str]] = ()) -> Column:
    """array of struct(pattern_label, severity, matched_text) for all patterns that hold, one match each; low: fold(text)."""
    found = []
    for (p, label, severity), needles in [*zip(K.INJECTION, NEEDLES, strict=True), *((e, ()) for e in extra)]:
        if K.SEVERITY[severity] >= K.SEVERITY[min_severity]:
            p = "(?uU)" + p
            item = F.struct(F.lit(label).alias("pattern_label"), F.lit(severity).alias("severity"), F.substring(F.regexp_extract(text, p, 0), 1, 120).alias("matched_text"))
            hit = text.rlike(p)
            if needles:
                hit = reduce(lambda a, b: a | b, [low.contains(n) for n in needles]) & hit
            found.append(F.when(hit, item))
    return F.array_compact(F.array(*found))


def injection_matches(text: Column, min_severity: str = "low", extra: list[tuple[str, str, str]] = ()) -> Column:
    return let(fold(text), lambda low: injection_found(text, low, min_severity, extra))


def with_injection(df, text: str, out: str, min_severity: str = "low", extra: list[tuple[str, str, str]] = ()):
    """df with struct out as injection() gives it, in steps that are compiled; text names a column."""
    low, found = f"__low_{out}", f"__found_{out}"
    rows = df.withColumn(low, fold(F.col(text)))
    rows = rows.withColumn(found, injection_found(F.col(text), F.col(low), min_severity, extra)).drop(low)
    return rows.withColumn(out, _summary(F.col(found))).drop(found)


def worst(matches: Column) -> Column:
    """The first match of the highest severity."""
    rank = lambda m: _map(K.SEVERITY)[m["severity"]]
    return F.aggregate(F.slice(matches, 2, 1 << 20), F.get(matches, F.lit(0)), lambda acc, m: F.when(rank(m) > rank(acc), m).otherwise(acc))


def _summary(m: Column) -> Column:
    return F.struct((F.size(m) > 0).alias("detected"), worst(m)["severity"].alias("severity"), worst(m)["pattern_label"].alias("matched_pattern"), m.alias("matches"))


def injection(text: Column, min_severity: str = "low", extra: list[tuple[str, str, str]] = ()) -> Column:
    """struct(detected, severity, matched_pattern, matches)."""
    return let(injection_matches(text, min_severity, extra), _summary)


def injection_blocks(gate: Column, found: Column) -> Column:
    """Whether a gate policy blocks: input gates only, high and medium only."""
    return gate.isin(K.INPUT_GATES) & F.coalesce(found["severity"].isin("high", "medium"), F.lit(False))


# -- verdicts of guard models and decisions


def parse_verdict(raw: Column) -> Column:
    """struct(safe, category, categories) of a guard model's reply; only an explicit safe passes."""
    line = strip(F.get(F.split(F.lower(strip(raw)), "\n"), F.lit(0)))
    head = strip(F.substring_index(line, ":", 1))
    after = strip(F.regexp_replace(line, r"^[^:]*:", ""))
    line = F.when(line.contains(":") & head.isin("safety", "verdict", "result", "label", "assessment"), after).otherwise(line)
    line = F.regexp_replace(line, r"""^[ .!*_`"']+|[ .!*_`"']+$""", "")
    codes = F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(r"(?i)\bS\d{1,2}\b"), F.lit(0)), F.upper))
    none = F.array().cast("array<string>")
    safe = line == "safe"
    return F.struct(safe.alias("safe"), F.when(~safe, F.get(codes, F.lit(0))).alias("category"), F.when(safe, none).otherwise(codes).alias("categories"))


def guard_prompt(text: Column, gate: Column, categories: list[str] | None = None) -> Column:
    """What a guard model of the Llama Guard 3 format is asked about a text; the gate output asks of the agent's words."""
    listed = "\n".join(f"{c}: {K.CATEGORIES.get(c, c)}" for c in categories or K.CATEGORIES)
    is_input = gate.isin(K.INPUT_GATES)
    asked = F.when(is_input, K.PROMPT["input"]).otherwise(K.PROMPT["output"])
    begin, end = (F.when(is_input, K.PROMPT[f"input_{x}"]).otherwise(K.PROMPT[f"output_{x}"]) for x in ("begin", "end"))
    middle = F.lit(K.PROMPT["categories"].replace("LIST", listed))
    return F.concat(F.lit(K.PROMPT["head"]), asked, middle, begin, F.coalesce(text, F.lit("")), end, F.lit(K.PROMPT["tail"]))


def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cascade(prob: Column, mode="safety", slow: Column | None = None, fail_open=False) -> Column:
    """struct(safe, path) of the cascade: fast verdicts above 0.85 or, for speed, below 0.15; else the slow verdict,
    the fast one where there is none, and fail_open where there is neither.  Any mode but speed is safety.

    mode and fail_open are values or columns; safe and path are never null.
    """
    slow = F.lit(None).cast("boolean") if slow is None else slow
    mode = F.lit(mode) if isinstance(mode, str) else mode
    fail_open = F.lit(fail_open) if isinstance(fail_open, bool) else fail_open
    quick = F.coalesce((mode == "speed") & (prob < 0.15), F.lit(False))
    sure = F.when(prob > 0.85, F.lit(False)).when(quick, True).when(slow.isNotNull(), slow).when(prob.isNotNull(), prob < 0.5)
    path = F.when(prob > 0.85, "fast_unsafe").when(quick, "fast_safe").when(slow.isNotNull(), "escalated").when(prob.isNotNull(), "fast_fallback")
    blind = F.when(F.coalesce(fail_open, F.lit(False)), "fail_open").otherwise("fail_closed")
    return F.struct(sure.otherwise(F.coalesce(fail_open, F.lit(False))).alias("safe"), path.otherwise(blind).alias("path"))


def action(allowed: Column, safe: Column, has_pii: Column, pii_action: Column) -> Column:
    """What is done with a text: out of scope and unsafe texts and, by policy, personal data are blocked; else masked."""
    return (
        F.when(~allowed, "block").when(~safe, "block").when(has_pii & (pii_action == "block"), "block").when(has_pii & (pii_action == "mask"), "mask").otherwise("pass")
    )
