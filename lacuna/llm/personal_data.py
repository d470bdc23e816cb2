"""Personal data: fixed patterns, and terms whose co-occurrence in the corpus discloses a protected value.

Information-theoretic sanitisation: a value v that the patterns find has the information IC(v) = log2(N / n_v); a term
t in the same text discloses PMI(t; v) = log2(n_tv * N / (n_t * n_v)) of that. Terms that disclose at least a given
share of IC(v), seen with v in enough different texts, are marked too, wherever they occur in any document. All four
counts are of documents, copies included. DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import ascii_lower, stored, whole
from lacuna.llm.decontamination import small

KINDS = ("email", "ip", "card", "phone")
#: The patterns, written so that no run of characters is scanned twice: a match can begin only at the start of a run of
#: its first class or right after the last match, and repetition is possessive where nothing after it could use less.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap condition that every text with a valid match meets.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": "+"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TERM = r"\p{L}+"


def _guard(kind: str, text: Column) -> Column:
    return F.contains(text, F.lit(GUARDS[kind])) if len(GUARDS[kind]) == 1 else text.rlike(GUARDS[kind])


def luhn(digits: Column) -> Column:
    """Whether a text of digits has a valid Luhn sum."""
    back = F.reverse(digits)
    doubled = lambda i: F.substring(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda sum_, i: sum_ + F.when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i)))
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == "ip", value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == "card", F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(True)
    )


def base_matches(docs: DataFrame) -> DataFrame:
    """For docs (doc_id, key, text): doc_id, key, kind, value, start, end of each valid match.

    The text between matches and the matches alternate; places are running sums of their lengths, as a window over the
    few rows of one text and kind. Equal rows count once.
    """
    parts = None
    for kind in KINDS:
        p = F.lit(PATTERNS[kind])
        own = docs.where(_guard(kind, F.col("text"))).select(
            "doc_id", "key", F.split("text", PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all("text", p, F.lit(0)).alias("found")
        )
        own = own.where("size(found) > 0").select("doc_id", "key", "gaps", F.posexplode("found").alias("i", "value"))
        own = own.select(
            "doc_id",
            "key",
            F.lit(kind).alias("kind"),
            "i",
            "value",
            F.char_length(F.get("gaps", F.col("i"))).alias("gap"),
        )
        parts = own if parts is None else parts.unionByName(own)
    parts = parts.dropDuplicates(["doc_id", "key", "kind", "i"])
    running = Window.partitionBy("doc_id", "key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("end", F.sum(F.col("gap") + F.char_length("value")).over(running).cast("int")).withColumn("start", F.col("end") - F.char_length("value"))
    return placed.where(_valid(F.col("kind"), F.col("value"))).select("doc_id", "key", "kind", "value", "start", "end")


def _unnamed(text: Column) -> Column:
    """The text with blanks in place of its emails, the only values that hold letters; places stay as they are."""
    parts = F.arrays_zip(F.split(text, PATTERNS["email"], -1).alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0)).alias("found"))
    blank = lambda x: F.concat(x["gap"], F.repeat(F.lit(" "), F.coalesce(F.char_length(x["found"]), F.lit(0))))
    return F.when(_guard("email", text), F.array_join(F.transform(parts, blank), "")).otherwise(text)


def _found_terms(text: Column) -> Column:
    return F.regexp_extract_all(_unnamed(text), F.lit(_TERM), F.lit(0))


def terms_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns and each different term of the text beside its values, in lower case."""
    return docs.select(*columns, F.explode(F.array_distinct(F.transform(_found_terms(F.col("text")), F.lower))).alias("term"))


def term_counts(docs: DataFrame) -> DataFrame:
    """term, n_t: the documents that hold each term, counted in the tasks first."""
    return terms_of(docs).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def disclosing_terms(docs: DataFrame, matches: DataFrame, share: float = 0.8, support: int = 3, counts: DataFrame | None = None) -> DataFrame:
    """kind, value, term, pmi, ic of the pairs that disclose: pmi >= share * ic, in at least `support` different texts.

    counts: term_counts(docs), where the caller has stored them.

    n_tv, n_v, n_t and N count documents, each copy of a text too; the support alone counts different texts. No pair is
    sought that can't disclose: as n_tv <= n_v, a term in more than N ** (1 - share) * n_v ** share documents doesn't.
    """
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    copies = docs.select("key").join(matches.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    held = stored(matches.select("kind", F.lower("value").alias("value"), "key").distinct().join(copies, "key"), "values")
    values = held.groupBy("kind", "value").agg(F.sum("copies").alias("n_v"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support)
    values = values.crossJoin(F.broadcast(total)).where("n_v < n")  # total is one row
    values = values.withColumn("most", F.pow("n", F.lit(1 - share)) * F.pow("n_v", F.lit(share)) * 1.000001)
    held = stored(held.join(small(stored(values.select("kind", "value", "n", "n_v", "most"), "frequent-values")), ["kind", "value"]), "frequent-places")
    keys = stored(held.groupBy("key").agg(F.max("most").alias("most_here")), "frequent-keys")
    terms = term_counts(docs) if counts is None else counts
    terms = stored(terms.where(F.col("n_t") >= support).crossJoin(F.broadcast(keys.agg(F.max("most_here").alias("top")))).where("n_t <= top").select("term", "n_t"), "terms")
    beside = terms_of(docs.join(small(keys), "key"), "key", "most_here").distinct()
    beside = beside.join(small(terms), (beside["term"] == terms["term"]) & (terms["n_t"] <= beside["most_here"])).select("key", beside["term"], "n_t")
    pairs = held.join(beside, "key").where("n_t <= most")
    pairs = pairs.groupBy("kind", "value", "term").agg(F.sum("copies").alias("n_tv"), F.count(F.lit(1)).alias("texts"), *(F.first(c).alias(c) for c in ("n", "n_v", "n_t")))
    scored = pairs.where(F.col("texts") >= support).withColumn("ic", F.log2(F.col("n") / F.col("n_v")))
    scored = scored.withColumn("pmi", F.log2(F.col("n_tv") * F.col("n") / (F.col("n_t") * F.col("n_v"))))
    return scored.where((F.col("ic") > 0) & (F.col("pmi") >= F.lit(share) * F.col("ic"))).select("kind", "value", "term", "pmi", "ic")


def texts_holding(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """key, here: the terms (term) that each text holds, for texts with any; stored."""
    wanted = small(stored(terms.select("term").distinct(), "disclosing"))
    return stored(terms_of(docs, "key").join(wanted, "term", "left_semi").groupBy("key").agg(F.collect_set("term").alias("here")), "disclosing-texts")


def places_of(docs: DataFrame, holding: DataFrame) -> DataFrame:
    """doc_id, key, start, end of every occurrence in docs (doc_id, key, text) of the terms that texts_holding() found; equal rows count once.

    Only texts that hold one are taken apart, and only the places of those terms leave them.
    """
    here = small(holding)
    text = F.col("text")
    parts = F.arrays_zip(F.split(_unnamed(text), _TERM, -1).alias("gap"), _found_terms(text).alias("found"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["found"]), F.lit(0))
        hit = F.coalesce(F.array_contains("here", F.lower(x["found"])), F.lit(False))
        return F.struct(end.alias("at"), F.when(hit, F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

    placed = docs.join(here, "key").select("doc_id", "key", F.explode(F.aggregate(parts, begin, step, lambda acc: acc["out"])).alias("x"))
    return placed.select("doc_id", "key", "x.start", "x.end").distinct()


def find_personal_data(docs: DataFrame, share: float = 0.8, support: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    Places count code points, ends are exclusive. Disclosing terms are spans of kind term, in every document. Null and empty texts have no
    spans; equal rows have equal results; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"), F.xxhash64(whole(F.col(text_col))).alias("key"))
    matches = stored(base_matches(docs), "matches")
    pairs = disclosing_terms(docs, matches, share, support)
    marked = places_of(docs, texts_holding(docs, pairs)).withColumn("kind", F.lit("term")).select("doc_id", "key", "kind", "start", "end")
    order = F.when(F.col("kind") == "email", 0).when(F.col("kind") == "ip", 1).when(F.col("kind") == "card", 2).when(F.col("kind") == "phone", 3).otherwise(4)
    spans = matches.select("doc_id", "key", "kind", "start", "end").unionByName(marked).withColumn("k", order)
    spans = spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("k", "start", "end", "kind"))).alias("s"))
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_kind = lambda n: F.size(F.filter("s", lambda x: x["k"] == n)).cast("long")
    counted = spans.select(
        F.col("doc_id").alias("d"),
        F.col("key").alias("k"),
        *(of_kind(n).alias(f"n_{kind}") for n, kind in enumerate((*KINDS, "term"))),
        text(F.filter("s", lambda x: x["k"] < 4)).alias("base"),
        text(F.col("s")).alias("all"),
    )
    rows = docs.select("doc_id", "key")
    rows = rows.join(counted, rows["doc_id"].eqNullSafe(counted["d"]) & (rows["key"] == counted["k"]), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select(
        "doc_id",
        *(zero(f"n_{kind}") for kind in KINDS),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("all", F.lit("")).alias("spans"),
        zero("n_term"),
    )


#: Letters of the longest beginning that is shown in place of a disclosing term.
LONGEST_START = 64


def starts_of(terms: DataFrame, *columns: str) -> DataFrame:
    """The columns and each beginning of term, of at most LONGEST_START letters, the whole term included."""
    cut = F.explode(F.sequence(F.lit(1), F.least(F.char_length("term"), F.lit(LONGEST_START)))).alias("n")
    return terms.select("term", *(c for c in columns if c != "term"), cut).select(*columns, F.substring("term", F.lit(1), F.col("n")).alias("start"))


def generalised_terms(docs: DataFrame, matches: DataFrame, pairs: DataFrame, counts: DataFrame, share: float = 0.8) -> DataFrame:
    """term, shown for each term of pairs (as disclosing_terms gives them): its longest proper beginning that discloses no value, and a star; empty where every beginning does.

    A beginning, of at most LONGEST_START letters, stands for all terms of the corpus that begin with it: n_c counts the documents with any of
    them, n_cv those that hold the value too, copies included. It discloses a value as a term does, whatever its support. Tested are the values
    of all disclosing terms that begin with it. docs: doc_id, key, text; matches: those of base_matches(); counts: term_counts(docs), stored.

    n_c lies between the most documents of one such term and the sum over all. Texts are read again only for beginnings that
    neither bound decides, and that are longer than what is known to do for one of their terms.
    """
    proper = starts_of(pairs.where(F.char_length("term") > 1), "kind", "value", "ic", "term").where("start <> term")
    starts = stored(proper, "starts")
    asked = starts.select("kind", "value", "ic", "start").distinct()
    of_term = starts.select("term", "start").distinct()
    wanted = small(stored(starts.select("start").distinct(), "wanted-starts"))
    held = matches.select("kind", F.lower("value").alias("value"), "key").distinct().join(asked.select("kind", "value").distinct(), ["kind", "value"], "left_semi")
    with_values = small(stored(held.select("key").distinct(), "texts-with-values"))
    copies = docs.select("key").join(with_values, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    held = stored(held.join(copies, "key"), "held-values")
    n_v = held.groupBy("kind", "value").agg(F.sum("copies").alias("n_v"))
    there = starts_of(terms_of(docs.join(with_values, "key", "left_semi"), "key"), "key").join(wanted, "start", "left_semi").distinct()
    # Each value meets its own terms' beginnings alone, so a text with many values and many terms isn't taken in pairs.
    n_cv = held.join(asked, ["kind", "value"]).join(there, ["key", "start"]).groupBy("kind", "value", "start").agg(F.sum("copies").alias("n_cv"))
    bounds = starts_of(counts, "n_t").groupBy("start").agg(F.max("n_t").alias("least"), F.sum("n_t").alias("most")).join(wanted, "start", "left_semi")
    scored = asked.join(n_cv, ["kind", "value", "start"]).join(n_v, ["kind", "value"]).join(bounds, "start").crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("total"))))  # one row
    scored = stored(scored, "scored-starts")
    told = lambda n_c: F.bool_or(F.log2(F.col("n_cv") * F.col("total") / (F.col(n_c) * F.col("n_v"))) >= F.lit(share) * F.col("ic"))
    judged = stored(scored.groupBy("start").agg(told("most").alias("tells"), (~told("least")).alias("safe")), "judged-starts")
    known = of_term.join(judged.where("safe").select("start"), "start").groupBy("term").agg(F.max(F.char_length("start")).alias("n"))
    open_ = of_term.join(judged.where("not safe and not tells").select("start"), "start").join(known, "term", "left").where(F.col("n").isNull() | (F.char_length("start") > F.col("n")))
    open_ = small(stored(open_.select("start").distinct(), "open-starts"))
    cover = small(stored(starts_of(counts, "term").join(open_, "start", "left_semi"), "covered-terms"))
    # A text's copies are as many as its key has rows with any one of its terms.
    n_c = terms_of(docs, "key").join(cover, "term").groupBy("key", "start", "term").agg(F.count(F.lit(1)).alias("copies"))
    n_c = n_c.groupBy("key", "start").agg(F.max("copies").alias("copies")).groupBy("start").agg(F.sum("copies").alias("n_c"))
    counted = scored.join(n_c, "start").groupBy("start").agg((~told("n_c")).alias("safe"))
    safe = judged.select("start", "safe").unionByName(counted).where("safe").select("start").distinct()
    longest = of_term.join(safe, "start").groupBy("term").agg(F.max_by("start", F.char_length("start")).alias("start"))
    return pairs.select("term").distinct().join(longest, "term", "left").select("term", F.coalesce(F.concat("start", F.lit("*")), F.lit("")).alias("shown"))


def sanitise(docs: DataFrame, share: float = 0.8, support: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text, n_values, n_generalised, n_removed.

    Values become their kind in brackets; a disclosing term becomes its longest beginning that discloses nothing, with a star, or goes where
    there is none. Null texts become empty, empty ones stay; equal rows have equal results; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"), F.xxhash64(whole(F.col(text_col))).alias("key"))
    matches = stored(base_matches(docs), "matches")
    counts = stored(term_counts(docs), "term-counts")
    pairs = stored(disclosing_terms(docs, matches, share, support, counts), "disclosing-pairs")
    shown = small(stored(generalised_terms(docs, matches, pairs, counts, share), "generalised"))
    holding = texts_holding(docs, pairs)
    places = places_of(docs, holding).withColumn("kind", F.lit("term"))
    spans = matches.select("doc_id", "key", "kind", "start", "end").unionByName(places.select("doc_id", "key", "kind", "start", "end"))
    before = Window.partitionBy("doc_id", "key").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("doc_id", "key", F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("kind").alias("k"), F.coalesce(F.max("end").over(before), F.lit(0)).alias("at")).alias("x"))
    spans = spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("x")).alias("spans")).withColumnsRenamed({"doc_id": "d", "key": "h"})
    here = holding.select("key", F.explode("here").alias("term")).join(shown, "term").groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("term", "shown"))).alias("shown"))
    rows = docs.join(spans, docs["doc_id"].eqNullSafe(spans["d"]) & (docs["key"] == spans["h"]), "left").join(here, "key", "left")
    found = F.coalesce("spans", F.array().cast("array<struct<s:int,e:int,k:string,at:int>>")).alias("found")
    parts = F.when(F.size("found") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))).alias("parts")
    rows = rows.select("doc_id", "text", "shown", found).select("doc_id", "text", "shown", "found", parts)
    cut = lambda a, b: _cut(F.col("parts"), a, b)
    word = lambda x: F.coalesce(F.try_element_at("shown", F.lower(cut(x["s"], x["e"]))), F.lit(""))
    named = F.transform("found", lambda x: F.when(x["k"] == "term", word(x)).otherwise(F.concat(F.lit("["), x["k"], F.lit("]")))).alias("words")
    rows = rows.select("doc_id", "text", "found", "parts", named)
    pair = F.filter(F.arrays_zip(F.col("found").alias("x"), F.col("words").alias("word")), lambda z: z["x"]["s"] >= z["x"]["at"])
    most = F.array_max(F.transform("found", lambda x: x["e"]))
    new = F.concat(F.array_join(F.transform(pair, lambda z: F.concat(cut(z["x"]["at"], z["x"]["s"]), z["word"])), ""), cut(most, F.char_length("text")))
    of_terms = F.size(F.filter("found", lambda x: x["k"] == "term"))
    gone = F.size(F.filter("words", lambda w: w == ""))
    # Within a lambda an alias of the same list hides the column of that name, so the new text is renamed afterwards.
    counted = rows.select(
        "doc_id", F.when(F.size("found") > 0, new).otherwise(F.col("text")).alias("clean"), (F.size("found") - of_terms).cast("long").alias("n_values"),
        (of_terms - gone).cast("long").alias("n_generalised"), gone.cast("long").alias("n_removed"),
    )
    return counted.withColumnRenamed("clean", "text")


#: Code points in each part of a text, so that a place in a long one is reached without walking through all before it.
PART = 1024


def _cut(parts: Column, a: Column, b: Column) -> Column:
    """Code points a to b of the text that parts hold."""
    first = F.floor(a / PART).cast("int")
    held = F.slice(parts, first + 1, F.floor((b - 1) / PART).cast("int") - first + 1)
    return F.when(b > a, F.substring(F.array_join(held, ""), a % PART + 1, b - a)).otherwise(F.lit(""))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with what the spans column of find_personal_data names taken out: values become their kind in brackets, terms go.

    Overlapping spans are taken in order of start; what lies in an earlier one isn't repeated.
    """
    part = lambda x, i: F.split(x, ":")[i]
    named = F.filter(F.split(spans, ","), lambda x: x != "")
    parsed = F.array_sort(F.transform(named, lambda x: F.struct(part(x, 1).cast("int").alias("s"), part(x, 2).cast("int").alias("e"), part(x, 0).alias("k"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        word = F.when(x["k"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), x["k"], F.lit("]")))
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        return F.struct(F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, word)).alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    return F.aggregate(parsed, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
