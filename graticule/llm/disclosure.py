"""Information-theoretic sanitisation of personal data.

Protected entities are e-mail addresses, IP addresses, card and phone numbers, found by
fixed patterns in the whole text.  Other terms can give an entity away too.  Each
mention counts for the entity itself, for its group (mail domain, half of an address,
first digits of a number) and for its kind, so entities named once or twice take part.
Over the corpus, a term's documents near an entity, group or kind e (within ``reach``
words of a mention) and all its documents give a rate; ``c`` different surroundings
smooth it to P(e|t) = rate * c / (c + ``unseen``).  With the share P(e) this gives

* the uncertainty left once the term is known, ``-log2 P(e|t)``, and
* the pointwise mutual information ``log2 P(e|t) / P(e)``.

A term discloses e if it leaves at most ``hint_bits`` and has at least half of the
information of e; it is generalised (kind ``hint``: replaced by the kind of entity that
it points to), or removed (kind ``term``) if it leaves at most ``term_bits``.  Copies of
one text have one surroundings and prove nothing: 0.58 bits are left, with two
surroundings 0.32.  Every occurrence of a disclosing term in the corpus gets a span,
unless it overlaps a protected entity.

Secrets are entities that no pattern names.  A value is a run of 16 or more letters and
digits with both in it; its term is the word that it is assigned to (``token = ...``),
else its first four characters where these are letters (``AKIA...``).  The term's
documents with a value, over its documents with any run of that length in that place,
give the rate above, smoothed by the number of different values ``c``; for first
characters ``c`` must also exceed chance, as hexadecimal values begin alike in one of
65,536 cases.  A term that leaves at most ``hint_bits`` makes all its values spans of
kind ``secret``; one that holds an entity of a pattern is a span beside it.

Terms are lower-cased runs of letters outside protected entities.  What the driver
gathers is a bit filter of fixed size; the terms themselves stay in joins.  A text is
searched whole and in linear time, however long it is.  A null text counts as empty; null and
repeated ids are allowed, as spans depend on the text alone.
"""

import re
from bisect import bisect_left
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from graticule.llm.common import free_name, letters, named
from graticule.session import durable

KINDS = ["email", "ip", "card", "phone"]
TERM_KINDS = ["term", "hint", "secret"]
# The patterns of protected entities, with runs of digits entered at
# their beginning only.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
# Values long enough for a secret, and what they are assigned to.
RUN = re.compile("(?<![A-Za-z0-9])[A-Za-z0-9]{16,}")
ASSIGNED = re.compile(r"""[:=][ \t]{0,3}["'`]?([^\s"'`:=]{16,})""")
KEY = re.compile(r"""([^\W\d_]{1,40})["'`]?[ \t]{0,3}[:=]?\Z""")
PREFIX = 4
CHANCE = 16 / 16 ** PREFIX
FILTER_BITS = 23
SPANS = "array<struct<start:bigint,order:int,kind:string,end:bigint>>"


def emails(text):
    end, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > end and text[low - 1] in LOCAL:
            low -= 1
        found = DOMAIN.match(text, at + 1) if low < at else None
        if found:
            end = found.end()
            yield low, end
        at = text.find("@", max(at + 1, end))


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def protected(text):
    """Spans (start, order of the kind, kind, end) of a text, sorted."""
    out = [(a, 0, "email", b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text)
                if all(len(p) < 4 and int(p) < 256 or int(p.lstrip("0")[:4] or 0) < 256
                       for p in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = DIGIT.findall(m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, "card", m.end()))
        if "+" in text:
            out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text)
                    if 10 <= len(DIGIT.findall(m.group())) <= 15]
    return sorted(out)


def levels(kind, match):
    """An entity, its group and its kind; no match holds a ``*``."""
    digits = "".join(DIGIT.findall(match))
    group = {
        "email": lambda: "@" + match.partition("@")[2].lower(),
        "ip": lambda: ".".join(match.split(".")[:2]) + ".",
        "card": lambda: digits[:4],
        "phone": lambda: "+" + digits[:4],
    }[kind]()
    return f"{kind}:{match}", f"{kind}:{group}*", f"{kind}:*"


def free_words(text, spans):
    """(start, lower-cased word) of the words that overlap none of the sorted spans."""
    out, at, covered = [], 0, 0
    for m in letters.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            covered = max(covered, spans[at][3])
            at += 1
        if covered <= m.start():
            out.append((m.start(), m.group().lower()))
    return out


def surroundings(text, spans, reach):
    """{(entity, group or kind; term): hashes of the surroundings} of a text's spans.

    A word near two mentions counts with the first, so one place is one proof.
    """
    words = free_words(text, spans)
    starts = [w[0] for w in words]
    out, met = {}, set()
    for start, _, kind, end in spans:
        at = bisect_left(starts, start)
        near = words[max(0, at - reach):at + reach]
        context = xxhash.xxh64_intdigest(" ".join(w[1] for w in near), 1) >> 1
        for entity in levels(kind, text[start:end]):
            for place, term in near:
                if (entity, place) not in met:
                    met.add((entity, place))
                    out.setdefault((entity, term), set()).add(context)
    return out


def mixed(run):
    return not run.isalpha() and not run.isdigit()


def claims(text):
    """{term of a secret: [(hash of the value, start, end)]}; empty where long runs are no values."""
    out, taken = {}, set()
    value = lambda m: (xxhash.xxh64_intdigest(m.group(), 1) >> 1, m.start(), m.end())
    for m in ASSIGNED.finditer(text):
        key = KEY.search(text, max(0, m.start() - 64), m.start())
        if key:
            places = out.setdefault(key.group(1).lower() + "=", [])
            run = RUN.match(text, m.start(1), m.end(1))
            if run and mixed(run.group()) and not any(map(str.isalnum, text[run.end():m.end(1)])):
                places.append(value(run))
                taken.add(run.start())
    for m in RUN.finditer(text):
        start = text[m.start():m.start() + PREFIX]
        if start.isalpha() and m.start() not in taken:
            places = out.setdefault(start + "*", [])
            if mixed(m.group()):
                places.append(value(m))
    return out


def find(text: Column, reach=8) -> Column:
    """Struct of the protected spans, of what stands near them, and of possible secrets."""
    kind = (f"struct<spans:{SPANS},"
            "near:array<struct<entity:string,term:string,contexts:array<bigint>>>,"
            "claims:array<struct<term:string,places:array<struct<value:bigint,start:bigint,end:bigint>>>>>")

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for text in texts.to_pylist():
                spans = protected(text) if text else []
                near = surroundings(text, spans, reach) if spans else {}
                rows.append({
                    "spans": [dict(zip(("start", "order", "kind", "end"), s)) for s in spans],
                    "near": [{"entity": e, "term": t, "contexts": list(c)}
                             for (e, t), c in near.items()],
                    "claims": [{"term": t, "places": [dict(zip(("value", "start", "end"), v)) for v in places]}
                               for t, places in claims(text or "").items()]})
            yield pa.array(rows, pa.struct([
                ("spans", pa.list_(pa.struct([
                    ("start", pa.int64()), ("order", pa.int32()), ("kind", pa.string()),
                    ("end", pa.int64())]))),
                ("near", pa.list_(pa.struct([
                    ("entity", pa.string()), ("term", pa.string()),
                    ("contexts", pa.list_(pa.int64()))]))),
                ("claims", pa.list_(pa.struct([
                    ("term", pa.string()), ("places", pa.list_(pa.struct([
                        ("value", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])))])))]))

    return run(text)


def term_filter(terms: DataFrame) -> np.ndarray:
    """Bits of the hashes of ``term``: of one size, whatever the number of terms."""
    place = F.pmod(F.xxhash64("term"), F.lit(1 << FILTER_BITS))
    words = terms.select(F.shiftright(place, 5).cast("int").alias("w"), F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), (place % 32).cast("int")).alias("b")).groupBy("w").agg(
        F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    bits[np.asarray(words["w"])] = np.asarray(words["b"]).astype(np.uint32)
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def terms_of(text):
    """Distinct terms; letters are found in the text as it is, as lower case can split a word."""
    return {w.lower() for w in set(letters.findall(text))}


def passing(words, bits):
    """Those of distinct words that the filter lets through."""
    digest, mask = xxhash.xxh64_intdigest, (1 << FILTER_BITS) - 1
    # the sign of the hash does not change its low bits
    return [w for w in words if bits[digest(w, 42) & mask]]


def document_counts(docs: DataFrame, text, bits) -> DataFrame:
    """(term, n): documents that hold a term, for terms that pass the filter."""

    def count(batches):
        seen = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                for w in passing(terms_of(t or ""), bits):
                    seen[w] = seen.get(w, 0) + 1
            if len(seen) > 200_000:
                yield _pairs(seen)
                seen = {}
        yield _pairs(seen)

    return docs.select(named(text)).mapInArrow(count, "term string, n bigint").groupBy("term").agg(
        F.sum("n").alias("n"))


def _pairs(seen):
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
        names=["term", "n"])


def occurrences(text: Column, bits) -> Column:
    """Places of the terms of each text that pass the filter."""

    @F.arrow_udf("array<struct<term:string,start:bigint,end:bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for t in texts.to_pylist():
                t = t or ""
                hits = set(passing(terms_of(t), bits))
                rows.append([{"term": w, "start": m.start(), "end": m.end()}
                             for m in letters.finditer(t) if (w := m.group().lower()) in hits]
                            if hits else [])
            yield pa.array(rows, pa.list_(pa.struct([
                ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return run(text)


def disclosing_terms(found: DataFrame, docs: DataFrame, text, hint_bits=0.5, term_bits=0.1,
                     unseen=0.5) -> DataFrame:
    """(term, kind, entity_kind): terms that give an entity away, one row each."""
    # the first surroundings of a document carry its count
    near = found.select(F.explode("near").alias("x")).select(
        "x.entity", "x.term", F.posexplode("x.contexts").alias("place", "context"))
    seen = F.col("contexts") / (F.col("contexts") + unseen)
    # counts per surroundings first, so a frequent entity is combined before the shuffle;
    # a rate is 1 at most, so pairs that leave too much even then need no further counts
    pairs = durable(near.groupBy("entity", "term", "context").agg(
        F.count_if(F.col("place") == 0).alias("n")).groupBy("entity", "term").agg(
        F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("contexts")).where(
        -F.log2(seen) <= hint_bits))
    total = found.count()
    entities = found.select(F.explode(F.array_distinct(F.transform(
        "near", lambda x: x["entity"]))).alias("entity")).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_entity"))
    counts = document_counts(docs, text, term_filter(pairs.select("term").distinct()))
    rate = F.least(F.col("n_both") / F.col("n"), F.lit(1.0))
    # few pairs are left when kinds, which hold many of them, meet their shares
    known = pairs.join(counts, "term").withColumn("left", -F.log2(rate * seen)).where(
        F.col("left") <= hint_bits).join(entities, "entity")
    left, own = F.col("left"), -F.log2(F.col("n_entity") / total)
    told = known.where((own > 0) & (own - left >= own / 2))
    # the strongest disclosure decides; equal ones by the entity
    best = told.groupBy("term").agg(F.min(F.struct(left.alias("left"), "entity")).alias("b"))
    return durable(best.select(
        "term", F.when(F.col("b.left") <= term_bits, "term").otherwise("hint").alias("kind"),
        F.substring_index("b.entity", ":", 1).alias("entity_kind")))


def secret_terms(found: DataFrame, hint_bits=0.5, unseen=0.5) -> DataFrame:
    """Terms whose long runs are secrets, one row each."""
    claim = found.select(F.explode("claims").alias("x")).select("x.term", "x.places")
    values = claim.select("term", F.explode("places").alias("p")).select("term", "p.value").distinct()
    counts = durable(values.groupBy("term").agg(F.count(F.lit(1)).alias("values")))
    free = F.col("term").endswith("*")
    chance = CHANCE * (counts.where(free).agg(F.sum("values")).first()[0] or 0)
    seen = F.col("values") / (F.col("values") + unseen + F.when(free, F.lit(chance)).otherwise(0.0))
    rates = claim.groupBy("term").agg(F.avg((F.size("places") > 0).cast("double")).alias("rate"))
    # terms without any value have no row among the counts
    return durable(rates.join(counts, "term").where(-F.log2(F.col("rate") * seen) <= hint_bits).select("term"))


def find_spans(docs: DataFrame, key="doc_id", text="text", reach=8, **limits) -> DataFrame:
    """(key, _text, base, spans): one row per row of ``docs``.

    ``base`` holds the protected spans, ``spans`` these, the disclosing terms and the
    secrets, both sorted by start and kind; ``_text`` is a hash of the text.
    """
    found = durable(docs.select(
        named(key).alias(key), F.md5(F.coalesce(named(text), F.lit("")).cast("binary")).alias("_text"),
        find(named(text), reach).alias("f")).select(key, "_text", "f.*"))
    base = found.select(key, "_text", F.col("spans").alias("base"))
    order = lambda kind: F.lit(len(KINDS) + TERM_KINDS.index(kind)).cast("int")
    secrets = found.select(F.col(key).alias("_key"), F.col("_text").alias("_md5"), F.explode("claims").alias("x")).join(
        secret_terms(found, **{k: v for k, v in limits.items() if k != "term_bits"}), F.col("x.term") == F.col("term")
    ).select("_key", "_md5", F.explode("x.places").alias("p")).select(
        "_key", "_md5", "p.start", order("secret").alias("order"), F.lit("secret").alias("kind"), "p.end")
    terms = disclosing_terms(found, docs, text, **limits)
    marks = secrets
    if not terms.isEmpty():
        placed = docs.select(
            named(key).alias("_key"), F.md5(F.coalesce(named(text), F.lit("")).cast("binary")).alias("_md5"),
            F.explode(occurrences(named(text), term_filter(terms))).alias("o")).select("_key", "_md5", "o.*")
        hint = F.col("kind") == "hint"
        marks = secrets.unionByName(placed.join(terms, "term").select(
            "_key", "_md5", "start", F.when(hint, order("hint")).otherwise(order("term")).alias("order"),
            F.concat("kind", F.when(hint, F.concat(F.lit("/"), "entity_kind")).otherwise("")).alias("kind"), "end"))
    marks = marks.groupBy("_key", "_md5").agg(
        F.collect_set(F.struct("start", "order", "kind", "end")).alias("_marks"))
    joined = base.join(marks, F.col(key).eqNullSafe(F.col("_key")) & (
        F.col("_text") == F.col("_md5")), "left")
    free = F.filter(
        F.coalesce("_marks", F.array().cast(SPANS)),
        lambda m: ~F.exists("base", lambda b: F.when(
            m["kind"] == "secret", (b["start"] <= m["start"]) & (m["end"] <= b["end"])).otherwise(
            (m["start"] < b["end"]) & (b["start"] < m["end"]))))
    return joined.select(
        key, "_text", "base", F.sort_array(F.concat("base", free)).alias("spans"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas; a hint's kind without its target."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.substring_index(s["kind"], "/", 1), s["start"].cast("string"),
        s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """Texts with spans replaced: entities, secrets and hints by their kind, terms by nothing.

    Overlapping spans are replaced together, by the kind of the first.
    """

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            out = []
            for t, found in zip(texts.to_pylist(), lists.to_pylist()):
                if t and found:
                    parts, at = [], 0
                    for s in found:
                        if s["start"] >= at:
                            kind = s["kind"]
                            label = "" if kind == "term" else (
                                f"[{kind.partition('/')[2]} related]" if "/" in kind else f"[{kind}]")
                            parts += [t[at:s["start"]], label]
                        at = max(at, s["end"])
                    t = "".join(parts) + t[at:]
                out.append(t)
            yield pa.array(out, pa.string())

    return run(text, spans)


def sanitise(docs: DataFrame, key="doc_id", text="text", **settings) -> DataFrame:
    """``docs`` with the spans of each text replaced; other columns as they are.

    Texts meet their spans on (key, hash of the text), of which each pair is kept once.
    """
    columns = docs.columns
    k, h, s = (free_name(docs, x) for x in ("_key", "_hash", "_spans"))
    marked = find_spans(docs, key, text, **settings).where(F.size("spans") > 0).select(
        F.col(key).alias(k), F.col("_text").alias(h), F.col("spans").alias(s))
    marked = marked.dropDuplicates([k, h])
    joined = docs.join(marked, [
        named(key).eqNullSafe(F.col(k)),
        F.md5(F.coalesce(named(text), F.lit("")).cast("binary")) == F.col(h)], "left")
    return joined.select(*[
        redact(named(c), F.col(s)).alias(c) if c == text else named(c) for c in columns])
