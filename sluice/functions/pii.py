"""Column functions for personal data: detection with offsets, checks, merging, context, masks and vault tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import fixed as K

ENTITY = "struct<text:string,label:string,score:double,start:int,end:int,method:string>"
ENTITIES = f"array<{ENTITY}>"
#: Places of a term that are summed together.
BLOCK = 32


def _none() -> Column:
    return F.array().cast(ENTITIES)


def entity(text: Column, label: Column, score: Column, start: Column, end: Column, method: Column) -> Column:
    return F.struct(
        text.cast("string").alias("text"),
        label.cast("string").alias("label"),
        score.cast("double").alias("score"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        method.cast("string").alias("method"),
    )


def matches(text: Column, pattern: str) -> Column:
    """array of struct(hit, start) of all matches, by the lengths of gaps and matches."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(hits), F.lit(1))), hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    pairs = F.filter(pairs, lambda p: p["hit"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<hit:string,start:int>>").alias("out"))

    def step(acc, p):
        at = acc["at"] + p["gap"]
        return F.struct((at + F.length(p["hit"])).alias("at"), F.concat(acc["out"], F.array(F.struct(p["hit"].alias("hit"), at.alias("start")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def luhn(text: Column) -> Column:
    digits = F.regexp_replace(text, r"\D", "")
    return (F.length(digits) >= 13) & F.call_function("luhn_check", digits)


def iban(text: Column) -> Column:
    """Remainder 1 modulo 97 of the rearranged number, letters as two digits."""
    plain = F.upper(F.replace(text, F.lit(" "), F.lit("")))
    chars = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")

    def step(acc, c):
        code = F.ascii(c)
        return F.when((code >= 48) & (code <= 57), (acc * 10 + code - 48) % 97).when((code >= 65) & (code <= 90), (acc * 100 + code - 55) % 97).otherwise(F.lit(None).cast("int"))

    rest = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), step)
    return plain.rlike(r"^[A-Z]{2}\d{2}.") & F.coalesce(rest == 1, F.lit(False))


def ssn(text: Column) -> Column:
    d = F.regexp_replace(text, r"\D", "")
    area, group, serial = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    return (F.length(d) == 9) & ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")


CHECKS = {"credit_card": luhn, "iban": iban, "ssn": ssn}


def _scored(label: str, check):
    """The entity of a match, null where its check fails; a card number that fails is a weak one."""
    score = float(K.AMBIGUOUS_SCORE if label in K.AMBIGUOUS else K.BASE_SCORE)
    weak = check is not None and label == "credit_card"

    def of(m):
        hit = F.regexp_replace(m["hit"], r"(?U)^\s+|\s+$", "")
        good = check(m["hit"]) if check else F.lit(True)
        value = F.when(good, F.lit(score)).otherwise(F.lit(K.WEAK_SCORE)) if weak else F.lit(score)
        method = F.when(good, "regex").otherwise("regex_weak") if weak else F.lit("regex")
        item = entity(hit, F.lit(label), value, m["start"], m["start"] + F.length(m["hit"]), method)
        return F.when((hit != "") & (good | F.lit(weak)), item)

    return of


def regex_entities(text: Column, labels: list[str] | None = None, custom: dict[str, str] | None = None) -> Column:
    """Entities of all labels with a pattern, in the order of labels, then custom ones (which ignore case).

    A failed check drops a match, but for a card number, which stays as a weak one.
    """
    custom = custom or {}
    labels = [*(labels or K.PII_LABELS), *[c for c in custom if c not in (labels or K.PII_LABELS)]]
    out = []
    for label in labels:
        pattern = "(?iuU)" + custom[label] if label in custom else "(?U)" + K.PII[label] if label in K.PII else None
        if pattern is None:
            continue
        check = CHECKS.get(label) if label not in custom else None
        found = F.array_compact(F.transform(matches(text, pattern), _scored(label, check))).cast(ENTITIES)
        out.append(F.when(text.rlike(pattern), found).otherwise(_none()))
    return F.concat(*out) if out else _none()


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once: what stands in a lambda is evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def _places(text: Column, term: str) -> Column:
    """Entities of every place of a term, case aside.

    The lower-cased text is split before each place; sums of the lengths are the places.  They are taken in blocks, so
    that neither the places nor the text are gone through anew for each of them.
    """
    low, n = term.lower(), len(term)
    item = lambda hit, at: entity(hit, F.lit("deny_list"), F.lit(1.0), at, at + n, F.lit("deny_list"))
    if not low:
        return F.when(text.isNotNull(), F.transform(F.sequence(F.lit(0), F.length(text)), lambda i: item(F.lit(""), i)).cast(ENTITIES)).otherwise(_none())
    place = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    block = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,size:int,inside:array<int>>>").alias("out"))

    def inside(sizes):
        return F.aggregate(sizes, place, lambda a, size: F.struct((a["at"] + size).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def blocks(sizes):
        add = lambda a, p: F.struct((a["at"] + p["at"]).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), p["at"].alias("size"), p["out"].alias("inside")))).alias("out"))
        parts = F.transform(F.sequence(F.lit(1), F.size(sizes), F.lit(BLOCK)), lambda x: inside(F.slice(sizes, x, BLOCK)))
        return F.aggregate(parts, block, add, lambda a: a["out"])

    def entities(t, lower):
        sizes = F.transform(F.split(lower, f"(?={re.escape(low)})", -1), lambda p: F.length(p))
        cut = lambda b: _let(F.substr(t, b["at"] + 1, b["size"] + n), lambda c: F.transform(b["inside"], lambda i: item(F.substr(c, i + 1, F.lit(n)), b["at"] + i)))
        every = F.flatten(F.transform(_let(sizes, blocks), cut))
        return F.slice(every, F.when(lower.startswith(low), 1).otherwise(2), 1 << 30).cast(ENTITIES)  # the first piece may be none

    return _let(text, lambda t: _let(F.lower(t), lambda lower: F.when(lower.contains(low), entities(t, lower)).otherwise(_none())))


def deny_entities(text: Column, terms: list[str]) -> Column:
    """Entities of every place of a term, overlapping ones too; terms in order."""
    return F.concat(_none(), *[_places(text, t) for t in sorted(set(terms))])


def overlaps(a: Column, b: Column) -> Column:
    """Whether two spans share more than half of the shorter one."""
    common = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    shorter = F.least(a["end"] - a["start"], b["end"] - b["start"])
    return F.when(shorter > 0, common / shorter > 0.5).otherwise(False)


def _with(e: Column, **values) -> Column:
    return entity(*[values.get(c, e[c]) for c in ("text", "label", "score", "start", "end", "method")])


def merge(primary: Column, secondary: Column | None = None) -> Column:
    """primary with corroborated scores, then secondary; of overlapping entities the better, or the earlier; sorted."""
    joined = primary
    if secondary is not None:

        def add(acc, s):
            first = F.array_position(F.transform(acc, lambda p: overlaps(s, p)), F.lit(True))
            raised = F.transform(acc, lambda p, i: F.when(i + 1 == first, _with(p, score=F.least(F.lit(1.0), p["score"] + K.CORROBORATION))).otherwise(p))
            return F.when(first > 0, raised.cast(ENTITIES)).otherwise(F.concat(acc, F.array(s).cast(ENTITIES)))

        joined = F.aggregate(secondary, primary, add)

    def keep(acc, e):
        first = F.array_position(F.transform(acc, lambda k: overlaps(e, k)), F.lit(True))
        swapped = F.transform(acc, lambda k, i: F.when((i + 1 == first) & (e["score"] > k["score"]), e).otherwise(k))
        return F.when(first > 0, swapped.cast(ENTITIES)).otherwise(F.concat(acc, F.array(e).cast(ENTITIES)))

    kept = F.aggregate(joined, _none(), keep)
    order = lambda a, b: (
        F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)
    )
    return F.array_sort(kept, order)


def _near(words: list[str]) -> str:
    return r"(?iuU)\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"


def boost(text: Column, entities: Column, words: dict[str, list[str]] | None = None) -> Column:
    """Entities with a quarter more where a word of their label stands near, the span itself aside."""
    words = K.CONTEXT if words is None else words

    def one(e):
        begin = F.greatest(F.lit(0), e["start"] - K.BEFORE)
        around = F.concat(F.substr(text, begin + 1, e["start"] - begin), F.lit(" "), F.substr(text, e["end"] + 1, F.lit(K.AFTER)))
        near = None
        for label, list_ in words.items():
            hit = around.rlike(_near(list_))
            near = F.when(e["label"] == label, hit) if near is None else near.when(e["label"] == label, hit)
        near = F.lit(False) if near is None else near.otherwise(False)
        return _with(e, score=F.when(near, F.least(F.lit(1.0), e["score"] + K.BOOST)).otherwise(e["score"]))

    return F.transform(entities, one).cast(ENTITIES)


def detect(
    text: Column,
    labels: list[str] | None = None,
    threshold=K.THRESHOLD,
    deny: list[str] = (),
    allow: list[str] = (),
    custom: dict[str, str] | None = None,
    context: dict[str, list[str]] | None = None,
    recognised: Column | None = None,
    only: Column | None = None,
) -> Column:
    """Entities at or above threshold (a value or a column) after merging, context and the allow list.

    recognised: entities of a recogniser model, if there is one.  context: more words by label; they raise labels that
    have words of their own a second time.  only: an array column of the labels that count in a row.
    """
    by_rule = regex_entities(text, labels, custom)
    if only is not None:
        by_rule = F.filter(by_rule, lambda e: F.array_contains(only, e["label"]))
    found = boost(text, merge(F.concat(deny_entities(text, list(deny)), by_rule), recognised))
    if context:
        found = boost(text, found, {**{k: v for k, v in context.items() if v and k not in K.CONTEXT}, **K.CONTEXT})
    if allow:
        found = F.filter(found, lambda e: ~F.lower(e["text"]).isin([a.lower() for a in allow]))
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.filter(found, lambda e: e["score"] >= threshold)


def mask(text: Column, entities: Column) -> Column:
    """Every span as [LABEL], from the right, so that starts stay true."""
    order = F.reverse(F.array_sort(F.transform(entities, lambda e, i: F.struct(e["start"].alias("start"), (-i).alias("i"), e["end"].alias("end"), e["label"].alias("label")))))

    def step(acc, e):
        name = F.concat(F.lit("["), F.replace(F.upper(e["label"]), F.lit(" "), F.lit("_")), F.lit("]"))
        return F.concat(F.substr(acc, F.lit(1), e["start"]), name, F.substr(acc, e["end"] + 1))

    return F.aggregate(order, text, step)


TOKEN = r"\{\{pii:[a-z0-9_]+:[0-9a-f]{32}\}\}"


def vault_token(salt: str, session: Column, label: Column, original: Column) -> Column:
    """The token of a value: the same for the same session, label and value, so that a task that runs again agrees."""
    key = F.sha2(F.concat_ws("\0", F.lit(salt), session.cast("string"), label, original), 256)
    return F.concat(F.lit("{{pii:"), label, F.lit(":"), F.substring(key, 1, 32), F.lit("}}"))


def vault_text(text: Column, entities: Column, session: Column, salt: str) -> Column:
    """Every span as its token, from the right."""
    order = F.reverse(F.array_sort(F.transform(entities, lambda e, i: F.struct(e["start"].alias("start"), (-i).alias("i"), e["end"].alias("end"), e["label"].alias("label"), e["text"].alias("text")))))

    def step(acc, e):
        original = F.when(e["text"] != "", e["text"]).otherwise(F.substr(text, e["start"] + 1, e["end"] - e["start"]))
        return F.concat(F.substr(acc, F.lit(1), e["start"]), vault_token(salt, session, e["label"], original), F.substr(acc, e["end"] + 1))

    return F.aggregate(order, text, step)


def vault_entries(df, text: str, entities: str, session: str, salt: str):
    """(session, token, label, original), one row for each distinct value of a session."""
    rows = df.select(F.col(session).alias("session"), F.explode(entities).alias("e"), F.col(text).alias("__t"))
    original = F.when(F.col("e.text") != "", F.col("e.text")).otherwise(F.substr("__t", F.col("e.start") + 1, F.col("e.end") - F.col("e.start")))
    rows = rows.select("session", F.col("e.label").alias("label"), original.alias("original")).distinct()
    return rows.select("session", vault_token(salt, F.col("session"), F.col("label"), F.col("original")).alias("token"), "label", "original")


def vault_original(entries, session, token: str):
    """(original,): the value of a token in a session of vault_entries(); no row where it is unknown."""
    return entries.where((F.col("session") == F.lit(session)) & (F.col("token") == token)).select("original")


def vault_sizes(entries):
    """(session, n): how many values each session holds."""
    return entries.groupBy("session").agg(F.count(F.lit(1)).alias("n"))


def vault_cleared(entries, sessions):
    """The entries that stay when sessions (session) have ended."""
    return entries.join(sessions.select("session").distinct(), "session", "left_anti")


def restore(text: Column, vault: Column) -> Column:
    """Known tokens (a map token to original) as their originals; unknown ones stay."""
    gaps = F.split(text, TOKEN, -1)
    hits = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.concat_ws("", F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(F.try_element_at(vault, h), h, F.lit("")))))
