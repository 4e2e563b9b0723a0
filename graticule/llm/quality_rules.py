"""Line-first cleaning with built-in functions only.

Every line is judged on its own by three rules, failing lines go, and a document
goes if too much of its text went with them.

* punctuation: shouting (a doubled ``!`` or ``?``) or symbols ``#*$%&|<>`` on more
  than ``symbol_share`` of the line's words;
* navigation: at least ``menu_parts`` bars, or other menu separators, on a line, and
  one for at most every ``menu_words`` words;
* boilerplate: phrases of ``BOILERPLATE`` make up at least ``phrase_share`` of the
  lower-cased line's characters, so a paragraph that only mentions one passes.

Lines without a word are neither judged nor counted.  A null or empty text has no
line; it fails the base rule of 50 words.  Every row is judged by itself, so repeated
ids and other columns have no influence.
"""

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from graticule.llm.common import SPACE, bind, free_name, named

# Phrases of licence, consent and navigation lines.
BOILERPLATE = [
    "all rights reserved", "licensed under the", "is licensed under", "terms of service",
    "privacy policy", "cookie policy", "accept cookies", "click here", "subscribe to our newsletter",
    "skip to content", "javascript is disabled",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookies akzeptieren",
    "tous droits réservés", "politique de confidentialité", "accepter les cookies",
    "todos los derechos reservados", "política de privacidad", "aceptar las cookies",
]


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def split_lines(text: Column) -> Column:
    """Lines with at least one word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_fails(line: Column, symbol_share=0.3, menu_parts=3, menu_words=4,
               phrase_share=0.2) -> Column:
    # counts build all matches, so words are counted only on lines with a mark
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    odd = F.regexp_count(line, F.lit(r"[#*$%&|<>]+|!!+|\?\?+"))
    bars = F.regexp_count(line, F.lit("[|»›·]"))
    marks = (odd > words * symbol_share) | ((bars >= menu_parts) & (bars * menu_words >= words))
    if symbol_share >= 0 and menu_parts > 0:
        marks = line.rlike(r"[#*$%&|<>»›·]|!!|\?\?") & marks

    def phrase(low):
        said = functools.reduce(operator.or_, [F.contains(low, F.lit(p)) for p in BOILERPLATE])
        phrases = F.char_length(low) - F.char_length(F.regexp_replace(low, "|".join(BOILERPLATE), ""))
        return said & (phrases >= F.char_length(line) * phrase_share)

    return marks | bind(F.lower(line), phrase)


def repeated_words(words: Column, width=3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more.

    Places of windows are sorted by the windows' hashes, those next to an equal one are
    marked, and the marked places, in order, cover ``width`` words each without counting
    one twice.  Where different windows have equal hashes, whole windows are sorted.
    """
    places = (1 << 24) - 1  # a place lies in the low bits, below the hash

    def of(w):
        hashed = F.transform(F.slice(w, 1, F.size(w) - (width - 1)), lambda x, i: F.xxhash64(
            x, *[F.get(w, i + k) for k in range(1, width)]).bitwiseAND(F.lit(~places)).bitwiseOR(i.cast("bigint")))
        once = lambda h: F.size(F.array_distinct(F.transform(h, hash_of))) == F.size(h)
        return F.when(F.size(w) > places, exactly(w)).otherwise(bind(hashed, lambda h: F.when(
            once(h), F.lit(0)).otherwise(bind(F.sort_array(h), lambda s: bind(
                F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1))),
                lambda m: F.when(F.size(F.filter(m, lambda x, i: same(x, F.get(m, i + 1)) & differ(
                    w, x, F.get(m, i + 1)))) > 0, exactly(w)).otherwise(
                    cover(F.sort_array(F.transform(m, place)))))))))

    def place(x):
        return x.bitwiseAND(F.lit(places)).cast("int")

    def hash_of(x):
        return F.shiftright(x, 24)

    def same(a, b):  # null beyond the ends, which filters take as false
        return hash_of(a.bitwiseXOR(b)) == 0

    def differ(w, a, b):
        return functools.reduce(operator.or_, [
            F.get(w, place(a) + k) != F.get(w, place(b) + k) for k in range(width)])

    def exactly(w):
        # the last places have no whole window
        windows = F.transform(F.slice(w, 1, F.size(w) - (width - 1)), lambda x, i: F.concat_ws(
            " ", x, *[F.get(w, i + k) for k in range(1, width)]))
        return bind(windows, among)

    def among(windows):
        ordered = F.sort_array(
            F.transform(windows, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        return F.when(
            F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)
        ).otherwise(bind(ordered, twice))

    def twice(s):
        pairs = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(
            a["k"] == b["k"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        return bind(F.sort_array(F.array_distinct(F.flatten(pairs))), cover)

    def cover(places):
        return F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda s, i: F.struct(
                (s["n"] + i + width - F.greatest(s["end"], i)).alias("n"),
                (i + width).alias("end")),
            lambda s: s["n"])

    return F.when(F.size(words) > width, bind(words, of)).otherwise(F.lit(0)).cast("bigint")


def judge(text: Column, max_removed=0.5, min_words=50, max_repeated=50, **rules) -> Column:
    """Struct of the counts of one text, the cleaned text and the verdict."""
    text = F.coalesce(text, F.lit(""))
    lines = split_lines(text)
    base = F.struct(
        split_words(text).alias("words"),
        lines.alias("lines"),
        F.filter(lines, lambda x: ~line_fails(x, **rules)).alias("good"),
    )

    def of(b):
        counts = F.struct(
            F.size(b["words"]).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(b["words"], "")).cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            (F.size(b["lines"]) - F.size(F.array_distinct(b["lines"]))).cast("bigint")
            .alias("n_dup_lines"),
            repeated_words(b["words"]).alias("n_repeat_words"),
            F.char_length(F.array_join(b["lines"], "")).alias("seen"),
            F.array_join(b["good"], "\n").alias("clean_text"),
            (F.size(b["lines"]) - F.size(b["good"])).cast("bigint").alias("n_failed_lines"),
            F.char_length(F.array_join(b["good"], "")).alias("left"),
        )
        return bind(counts, verdict)

    def verdict(c):
        failed = (c["n_words"] < min_words) | (c["n_repeat_words"] * 100 > c["n_words"] * max_repeated)
        lost = c["seen"] - c["left"]
        return F.struct(
            *[c[k].alias(k) for k in (
                "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            failed.alias("base_failed"),
            (~failed & (lost <= c["seen"] * max_removed)).alias("kept"),
            c["n_failed_lines"], lost.cast("bigint").alias("removed_chars"), c["clean_text"],
        )

    return bind(base, of)


def clean_lines(docs: DataFrame, text="text", **settings) -> DataFrame:
    """``docs`` with one more column ``judged``: counts, verdict and cleaned text."""
    return docs.withColumn(free_name(docs, "judged"), judge(named(text), **settings))


def keep_good(docs: DataFrame, text="text", replace=False, **settings) -> DataFrame:
    """The rows kept, with the columns of ``docs``; ``replace`` puts the cleaned text in.

    A text without failing lines stays as it is, with its empty lines.
    """
    flag = free_name(docs, "judged")
    columns = docs.columns
    # a generator is not merged into what follows, so Python functions on the text see a column
    judged = docs.select("*", F.explode(F.array(judge(named(text), **settings))).alias(flag)).where(
        F.col(flag)["kept"])
    return judged.select(*[
        F.when(F.col(flag)["n_failed_lines"] > 0, F.col(flag)["clean_text"]).otherwise(named(c)).alias(c)
        if replace and c == text else named(c) for c in columns])
