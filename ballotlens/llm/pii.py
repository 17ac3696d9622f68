"""Personal data: base patterns, and identifiers found by bootstrapped context.

Base kinds (email, ip, card, phone) have fixed patterns.  Their instances are
the seeds.  What stands before an instance (its last one or two words, of at
most 120 characters, and a ``key=`` or ``key:`` that touches it) is a lexical
pattern.  The same is read off the candidates: every other token that holds a
digit or an at sign, digit groups joined by single blanks, dashes, points,
slashes and parentheses as one, and names on both sides of ``[at]``, ``(at)``
or ``_at_``.

Spark builds the graph of distinct (pattern, instance) edges over the whole
corpus and scores it in rounds:

* a pattern's reliability for a kind is the sum of its instances' scores for
  the kind over the number of its instances plus ``SMOOTHING``;
* a seed's score is one for its kind; a candidate's is one minus the product of
  (1 - reliability) of its patterns, if its characters suit the kind.

Patterns of ``MIN_RELIABILITY`` in the last round extract the candidates that
they precede as new spans of their kind.  Few instances can't reach it, nor can
a context that many kinds of token share.

Defined results: null counts as the empty text; whole texts are read; a
document's row is named by doc_id and its text (null ids too), so repeated
rows each give their row; extra columns go no further; an empty table gives an
empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballotlens.llm.common import arrays_to_batch, discard, lasting, small_batches, stored, temporary, text_of

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
SMOOTHING = 2.0
MIN_RELIABILITY = 0.85     # 12 instances of one kind, none of another
MIN_LENGTH = 5             # characters of a candidate without an at sign: fewer suit no kind
NO_ID = -(2**63)

# Fixed patterns.  A local part, and digits that begin an address, are found
# from their ends, so that long runs without one cost no more than their length.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_GROUPS = re.compile(r"(?<![0-9(+])[(+]*+[0-9]++\)?+(?:[ ./-]?+\(?+[0-9]++\)?+)++")
_AT = re.compile(r" ?[\[({]at[\])}] ?|_at_", re.IGNORECASE)
_HOST = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*[A-Za-z0-9]")
_TRIM_LEFT, _TRIM_RIGHT = "\"'(<[{*", ".,;:!?)]}>\"'*"


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind as listed."""
    found = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def joined(text: str) -> list[tuple[int, int]]:
    """Digit groups with blanks between them, and addresses with an at mark, that
    begin and end where tokens do."""
    found, done = [], 0
    for m in _GROUPS.finditer(text):
        a, b = m.span()
        if " " in m[0] and (a == 0 or text[a - 1].isspace() or text[a - 1] in _TRIM_LEFT + "=:") \
                and (b == len(text) or text[b].isspace() or text[b] in _TRIM_RIGHT):
            found.append((a, b))
    for m in _AT.finditer(text):
        a = m.start()
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        host = _HOST.match(text, m.end())
        done = host.end() if host else m.end()
        if host and a < m.start():
            found.append((a, host.end()))
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What no base span touches: joined groups, and tokens with a digit or an at
    sign outside them; of ``key=value`` and ``key:value`` the value."""
    taken, k = sorted((a, b) for a, b, _ in base), 0
    end = 0                                     # where the spans before k end
    groups = []
    for a, b in joined(text):
        while k < len(taken) and taken[k][0] < b:
            end = max(end, taken[k][1])
            k += 1
        if end <= a and (not groups or groups[-1][1] <= a) and b - a >= MIN_LENGTH:
            groups.append((a, b))
    return sorted(groups + _tokens(text, sorted(taken + groups)))


def _tokens(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, done, k, n = [], 0, 0, len(text)
    taken = 0                                   # where the spans before k end
    m = _DIGIT.search(text)
    while m:
        at = start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = at
        while end < n and not text[end].isspace():
            end += 1
        done = end
        while k < len(spans) and spans[k][0] < end:
            taken = max(taken, spans[k][1])
            k += 1
        if taken <= start:
            a, b = start, end
            cut = max(text.rfind(c, a, at) for c in "=:")
            a = cut + 1 if cut >= 0 else a
            while a < b and text[a] in _TRIM_LEFT:
                a += 1
            while b > a and text[b - 1] in _TRIM_RIGHT:
                b -= 1
            if b - a >= MIN_LENGTH or "@" in text[a:b]:
                out.append((a, b))
        m = _DIGIT.search(text, done)
    return out


def patterns(text: str, start: int) -> list[str]:
    """Lexical patterns of what stands before ``start`` on its line: the key
    that touches it and one, or two, words."""
    line = max(text.rfind("\n", max(0, start - 120), start) + 1, start - 120, 0)
    words = _DIGIT.sub("0", text[line:start].lower()).split(" ")
    touching, before = words[-1], [w for w in words[:-1] if w][-2:]
    out = [" ".join([*before[-1:], touching or "_"])]
    if len(before) == 2:
        out.append(" ".join([*before, touching or "_"]))
    return out


def suits(kind: str, value: str) -> bool:
    """Whether a candidate's characters suit a kind."""
    digits, letters = sum("0" <= c <= "9" for c in value), sum(c.isalpha() for c in value)
    if kind == "email":
        return "@" in value or letters >= 4 and _AT.search(value) is not None
    if kind == "ip":
        return digits >= 4 and ("." in value or ":" in value) and letters <= digits
    return digits >= 6 and letters == 0


_READ = ("doc long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base string, "
         "seen array<struct<start: int, end: int, kind: string, value: string, suits: array<string>, pattern: array<string>>>")


def read_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: base counts and spans, and what was seen (seeds
    with their kind, candidates with the kinds that they suit), with patterns."""
    small_batches(docs.sparkSession)
    text = text_of(docs, text_col)
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def read(batches):
        import pyarrow as pa
        one = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("suits", pa.list_(pa.string())), ("pattern", pa.list_(pa.string()))])
        schema = pa.schema([(c, pa.int64()) for c in ("doc", "text_hash", "n_email", "n_ip", "n_card", "n_phone")] + [("base", pa.string()), ("seen", pa.list_(one))])
        for b in batches:
            counts, base, seen = [[], [], [], []], [], []
            for t in b.column(2).to_pylist():
                spans = base_spans(t)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[2] == kind for s in spans))
                base.append(",".join(f"{kind}:{x}:{y}" for x, y, kind in spans))
                own = [{"start": x, "end": y, "kind": kind, "value": t[x:y].lower(), "suits": [kind], "pattern": patterns(t, x)} for x, y, kind in spans]
                own += [{"start": x, "end": y, "kind": None, "value": t[x:y].lower(), "suits": [k for k in KINDS if suits(k, t[x:y])], "pattern": patterns(t, x)}
                        for x, y in candidates(t, spans)]
                seen.append(own)
            yield arrays_to_batch(schema, [b.column(0), b.column(1), *counts, base, seen])

    return rows.mapInArrow(read, _READ)


def reliable_patterns(seen: DataFrame, rounds: int = ROUNDS, smoothing: float = SMOOTHING, min_reliability: float = MIN_RELIABILITY) -> DataFrame:
    """(pattern, kind, reliability) from the rows that ``read_spans`` saw.

    Patterns are kept as hashes.  Every grouping first adds up inside tasks, so
    a context that a third of all tokens share is one row a task.  The result is
    a written table; what the rounds leave behind is removed."""
    with temporary(seen.sparkSession):
        return lasting(_scored(seen, rounds, smoothing, min_reliability), "patterns")


def _scored(seen: DataFrame, rounds: int, smoothing: float, min_reliability: float) -> DataFrame:
    flat = seen.select(F.explode("seen").alias("s")).select(
        F.explode("s.pattern").alias("p"), F.xxhash64("s.value").alias("instance"), F.col("s.kind").alias("kind"), F.col("s.suits").alias("suits"))
    flat = flat.select(F.xxhash64("p").alias("pattern"), "instance", "kind", "suits")
    edges = stored(flat.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.max("suits").alias("suits")), "pattern-edges")
    sizes = stored(edges.groupBy("pattern").agg(F.count("*").alias("n")), "pattern-sizes")
    seeds = edges.filter("kind is not null").select("pattern", "kind", F.lit(1.0).alias("score"))
    # candidates that suit some kind; the others only count among a pattern's instances
    others = stored(edges.filter("kind is null").select("pattern", "instance", F.explode("suits").alias("kind")), "candidate-edges")
    learned, found = None, None
    for k in range(rounds):
        mass = seeds if learned is None else seeds.unionByName(
            others.join(learned, ["instance", "kind"]).select("pattern", "kind", "score"))
        sums = stored(mass.groupBy("pattern", "kind").agg(F.sum("score").alias("mass")), "pattern-mass")
        found = stored(sums.join(sizes, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("n") + smoothing)).alias("reliability")), "pattern-scores")
        if k + 1 < rounds:
            miss = F.log1p(-F.least("reliability", F.lit(0.999)))
            learned = stored(others.join(found.filter("reliability >= 0.5"), ["pattern", "kind"]).groupBy("instance", "kind")
                             .agg((1 - F.exp(F.sum(miss))).alias("score")), "instance-scores")
    best = F.row_number().over(Window.partitionBy("pattern").orderBy(F.desc("reliability"), "kind"))   # at most four rows each
    return found.filter(F.col("reliability") >= min_reliability).withColumn("r", best).filter("r = 1").drop("r")


def find_pii(docs: DataFrame, rounds: int = ROUNDS, smoothing: float = SMOOTHING, min_reliability: float = MIN_RELIABILITY,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_found): ``base``
    and ``spans`` are kind:start:end by start and kind, joined by commas."""
    seen = stored(read_spans(docs, id_col, text_col), "pii-seen")
    good = reliable_patterns(seen, rounds, smoothing, min_reliability)
    new = (seen.select("doc", "text_hash", F.explode("seen").alias("s")).filter("s.kind is null and size(s.suits) > 0")
           .select("doc", "text_hash", "s.start", "s.end", "s.suits", F.explode("s.pattern").alias("p"))
           .withColumn("pattern", F.xxhash64("p")).join(good, "pattern").filter(F.array_contains("suits", F.col("kind")))
           .groupBy("doc", "text_hash", "start", "end").agg(F.max_by("kind", F.struct("reliability", "kind")).alias("kind")))
    by_doc = stored(new.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "end", "kind")).alias("found")), "pii-found")
    discard(good)
    whole = seen.drop("seen").join(by_doc, ["doc", "text_hash"], "left")

    @F.arrow_udf("string")
    def merged(base: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for b, f in zip(base.to_pylist(), found.to_pylist(), strict=True):
            spans = [(int(x), int(y), k) for k, x, y in (s.split(":") for s in b.split(",") if s)]
            spans += [(int(s["start"]), int(s["end"]), s["kind"]) for s in (f if f is not None else [])]
            out.append(",".join(f"{k}:{x}:{y}" for x, y, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))))
        return pa.array(out, pa.string())

    spans = F.when(F.col("found").isNull(), F.col("base")).otherwise(merged("base", "found"))
    return whole.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base",
                        spans.alias("spans"), F.coalesce(F.size("found"), F.lit(0)).alias("n_found"))
