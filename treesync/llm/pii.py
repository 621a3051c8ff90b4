"""Information-theoretic sanitisation, with DataFrame functions only.

Base: e-mail addresses, IP addresses, card and phone numbers are found by patterns. They are the protected entities, each
also at a coarser level that recurs where the exact value doesn't: mail domain, first half of the address, issuer
digits, dialling prefix.

Terms: words of a text that holds an entity may reveal it after it is masked. From all documents come the number N, those
with the entity n(e), with the term n(t), and with both n(t,e), anywhere in the whole text; all four count different
texts, so copies prove nothing:
    PMI(t; e) = log2(N * n(t,e) / (n(t) * n(e)))      IC(e) = log2(N / n(e))
A term discloses the share PMI / IC of what the entity says. Beyond one threshold it is generalised to its band of
frequency, beyond a higher one removed, wherever it occurs in the documents that hold the entity. Documents without an
entity are left alone.

Nor does chance prove anything. With L = n(t) n(e) / N texts expected, the Poisson (Chernoff) bound for as many as n(t,e)
is divided by the chance 1 - exp(-L) that the two meet at all: of all pairs that met, those are taken of which a share of
at most ``error`` is expected to be chance (Benjamini and Hochberg, on whole bits).

Work. A share s of PMI to IC needs n(t) <= n(e)^s N^(1-s), so frequent words drop out once the document frequencies are
counted, before any pair is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.llm.common import bounded, join_classes, stage, table, with_row_address

#: Possessive forms of the patterns: the same leftmost matches, without backtracking. A run is only tried from its start, or from the end of the match before it.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of 12 to 19 digits only: shorter and longer runs are dropped anyway.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = r"\p{L}{3,}+"
#: Elements of a block of prefix sums.
BLOCK = 128
TERMS = "array<struct<start int, end int, removed boolean, band int>>"


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once however often the body, or a lambda in it, reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str) -> tuple[Column, Column]:
    """(matches, their starts in code points); prefix sums by blocks, so long texts cost no square."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    none = F.array().cast("array<int>")
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), (F.length(p) + F.length(m)).alias("step")))
    blocks = let(steps, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))
    # per block: starts from the block's own begin, and its length
    local = F.transform(
        blocks,
        lambda b: F.aggregate(
            b,
            F.struct(F.lit(0).alias("at"), none.alias("starts")),
            lambda acc, x: F.struct((acc["at"] + x["step"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["gap"])).alias("starts")),
        ),
    )
    joined = F.aggregate(
        local,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("starts")),
        lambda acc, b: F.struct(
            (acc["at"] + b["at"]).alias("at"),
            F.concat(acc["starts"], F.array(F.transform(b["starts"], lambda s: s + acc["at"]))).alias("starts"),
        ),
    )
    return matches, F.when(F.size(matches) > 0, F.flatten(joined["starts"])).otherwise(none)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda i: F.substring(number, F.length(number) - i, F.lit(1)).cast("int") * (1 + i % 2)
    total = F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda acc, i: acc + value(i) - F.when(value(i) > 9, 9).otherwise(0))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda part: part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def _entity(kind: str, m: Column) -> Column:
    return F.lower(m) if kind in ("email", "ip") else digits(m)


def _level(kind: str, m: Column) -> Column:
    """What many entities share: mail domain, first two parts of an address, six digits of a card number, three of a phone number."""
    if kind == "email":
        return F.lower(F.substring_index(m, "@", -1))
    return F.substring_index(m, ".", 2) if kind == "ip" else F.left(digits(m), F.lit(6 if kind == "card" else 3))


def _maybe(kind: str, text: Column) -> Column:
    """A cheap test that every text with such a match passes."""
    return F.contains(text, F.lit({"email": "@", "phone": "+", "ip": "."}[kind])) if kind != "card" else text.rlike("[0-9][ -]?[0-9]")


SPAN = "struct<start int, rank int, kind string, end int, entity string, level string>"


def _spans(kind: str, pattern: str, text: Column) -> Column:
    matches, starts = located(text, pattern)
    span = lambda m, start: F.struct(
        start.alias("start"),
        F.lit(KINDS.index(kind)).alias("rank"),
        F.lit(kind).alias("kind"),
        (start + F.length(m)).alias("end"),
        F.concat(F.lit(f"{kind}:"), _entity(kind, m)).alias("entity"),
        F.concat(F.lit(f"{kind} level:"), _level(kind, m)).alias("level"),
    )
    empty = F.array().cast(f"array<{SPAN}>")
    good = F.filter(F.zip_with(matches, starts, lambda m, start: F.struct(_valid(kind, m).alias("ok"), span(m, start).alias("span"))), lambda x: x["ok"])
    return F.when(_maybe(kind, text), F.transform(good, lambda x: x["span"])).otherwise(empty)


def base_spans(df: DataFrame, text: str, out: str = "base") -> DataFrame:
    """``df`` with the array of base spans by start, then kind; null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = [_spans(k, p, t) for k, p in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True)]
    return df.withColumn(out, F.array_sort(F.concat(*found)))


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _counted(weight: str = "weight") -> Column:
    """The number of different texts: rows weigh one over the copies of their text."""
    return F.round(F.sum(weight)).cast("long")


def _least_bits(bits: DataFrame, pairs: int, error: float) -> float:
    """The bits from which on a share of ``error`` at most of the pairs is expected to be chance, of ``bits(bits)`` of all ``pairs``; infinite if none are."""
    found = {r["b"]: r["n"] for r in bits.select(F.least(F.floor("bits"), F.lit(1000)).alias("b")).where("b > 0").groupBy("b").agg(F.count("*").alias("n")).collect()}  # 1,000 rows at most
    good = [b for b in found if 2.0**-b * pairs <= error * sum(n for c, n in found.items() if c >= b)]
    return float(min(good, default=float("inf")))


def sanitise(docs: DataFrame, generalise_at: float = 0.75, remove_at: float = 0.95, error: float = 0.05) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, text_hash (of the whole text), base (array of spans), terms (array of struct<start, end, removed, band>; at least 2^band different texts have the term, fewer than twice as many).

    Null text counts as empty and has no spans; null ids and repeated rows are rows like any other, but equal texts are
    evidence once. Terms never overlap base spans. Very long texts are one row, worked through in blocks of ``BLOCK`` matches.
    An empty table gives no rows; other columns are not read.
    """
    rows = with_row_address(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    rows = base_spans(rows, "text").withColumn("text_hash", F.xxhash64("text"))
    # of texts with an entity the rest, at its places, is kept for the terms
    rows = stage(rows.withColumn("rest", F.when(F.size("base") > 0, replaced(F.col("text"), F.col("base"), blank))).drop("text"), "spans")
    copies = stage(rows.groupBy("text_hash").agg(F.count("*").alias("weight")).where("weight > 1").withColumn("copies", F.col("weight")), "copies")
    repeated = copies.agg(F.sum("weight"), F.count("*")).first()
    total = rows.count() - (repeated[0] or 0) + repeated[1]
    n = F.lit(float(max(total, 1)))
    # each row weighs one over the copies of its text
    weighed = lambda df: join_classes(df, copies, ["text_hash"]).withColumn("weight", 1.0 / F.coalesce("copies", F.lit(1))).drop("copies")
    held = stage(weighed(rows.where("rest is not null").select("block", "pos", "text_hash", "base", "rest")), "holders")
    holders = held.select("block", "pos", "weight", F.explode(F.array_distinct(F.concat(F.transform("base", lambda s: s["entity"]), F.transform("base", lambda s: s["level"])))).alias("entity"))
    entities = holders.groupBy("entity").agg(_counted().alias("n_e")).where("n_e > 1")
    # a term of more documents can't disclose the share generalise_at
    entities = stage(entities.withColumn("most", F.pow("n_e", F.lit(generalise_at)) * F.pow(n, F.lit(1 - generalise_at))), "entities")
    most = entities.agg(F.max("most")).first()[0]
    words = held.select("block", "pos", "weight", F.explode(_words(F.col("rest"))).alias("term"))
    here = stage(words.groupBy("term").agg(_counted().alias("n")).where("n > 1").select("term"), "terms-here")
    everywhere = docs.select(F.col("text").cast("string").alias("text")).select(F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    n_t = weighed_words(everywhere, copies).groupBy("term").agg(_counted().alias("n_t")).where(F.col("n_t").between(2, most or 0))
    terms = stage(n_t.join(bounded(here), "term", "left_semi"), "terms")
    met = (
        words.join(bounded(terms), "term").join(holders.drop("weight").join(bounded(entities), "entity"), ["block", "pos"])
        .where("n_t <= most").select("block", "pos", "weight", "entity", "term", "n_t", "n_e")
    )
    expected = F.col("n_t") * F.col("n_e") / n
    pairs = met.groupBy("entity", "term").agg(_counted().alias("n_te"), F.max("n_t").alias("n_t"), F.max("n_e").alias("n_e"))
    tail = (F.col("n_te") * F.log(F.col("n_te") / expected) - F.col("n_te") + expected) / F.log(F.lit(2.0))
    bits = F.when((F.col("n_te") > 1) & (F.col("n_te") > expected), tail + F.log2(-F.expm1(-expected))).otherwise(0.0)
    pairs = stage(pairs.withColumn("bits", bits), "pairs")
    least = _least_bits(pairs, pairs.count(), error)
    ic, pmi = F.log2(n / F.col("n_e")), F.log2(n * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    disclosed = pairs.where((ic > 0) & (F.col("bits") >= least) & (pmi >= generalise_at * ic))
    disclosed = stage(disclosed.select("entity", "term", (pmi >= remove_at * ic).alias("removed"), F.floor(F.log2("n_t")).cast("int").alias("band")), "disclosed")
    hit = met.select("block", "pos", "entity", "term").join(bounded(disclosed), ["entity", "term"]).groupBy("block", "pos", "term").agg(F.max(F.struct("removed", "band")).alias("how"))
    hit = stage(hit.groupBy("block", "pos").agg(F.map_from_entries(F.collect_list(F.struct("term", "how"))).alias("hit")), "hit")  # of one document's words
    out = rows.join(bounded(hit), ["block", "pos"], "left")
    matches, starts = located(F.col("rest"), TERM)
    places = F.zip_with(matches, starts, lambda m, start: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.try_element_at("hit", F.lower(m)).alias("how")))
    found = F.when(F.col("hit").isNotNull(), F.filter(places, lambda t: t["how"].isNotNull()))
    found = F.transform(found, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["how"]["removed"].alias("removed"), t["how"]["band"].alias("band")))
    return out.select("doc_id", "text_hash", "base", F.coalesce(found, F.array().cast(TERMS)).alias("terms"))


def weighed_words(texts: DataFrame, copies: DataFrame, most: int = 400_000) -> DataFrame:
    """term, weight of the distinct words of ``texts(text_hash, text)``; a row weighs one over the copies of its text.

    Up to ``most`` repeated texts are a broadcast list. With more, texts of which there are copies are shuffled by their
    hash as distinct words, very frequent ones apart.
    """
    slim = lambda df: df.select(F.explode(_words(F.col("text"))).alias("term"), (1.0 / F.coalesce("copies", F.lit(1))).alias("weight"))
    few = copies.limit(most + 1).count() <= most
    return slim(texts.join(F.broadcast(copies.drop("weight")), "text_hash", "left") if few else join_classes(texts, copies, ["text_hash"]))


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def all_spans() -> Column:
    """Base spans and terms as struct<start, rank, kind, end, band>, by start, then kind."""
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(None).cast("int").alias("band")))
    terms = F.transform(
        "terms",
        lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.when(t["removed"], "removed").otherwise("term").alias("kind"), t["end"].alias("end"), t["band"].alias("band")),
    )
    return F.array_sort(F.concat(base, terms))


def blank(span: Column, begin: Column, first: Column) -> Column:
    """As many spaces, so that places stay."""
    return F.repeat(F.lit(" "), span["end"] - begin)


def label(span: Column, begin: Column, first: Column) -> Column:
    """The kind in brackets, for a term with its band: all words that about as many texts have read alike. Nothing for removed terms; overlapping spans are one."""
    band = F.coalesce(F.concat(F.lit(" 2^"), span["band"].cast("string")), F.lit(""))
    return F.when(first & (span["kind"] != "removed"), F.concat(F.lit("["), F.upper(span["kind"]), band, F.lit("]"))).otherwise(F.lit(""))


def replaced(text: Column, spans: Column, by) -> Column:
    """The text with each of the spans, which are sorted by start, replaced by ``by(span, begin, first)``; begin is its first place that no span before it covers.

    Works in blocks of spans, each on its own piece of the text, so that many spans of a long text cost no square.
    """
    return let(F.struct(text.alias("text"), spans.alias("spans")), lambda x: _replaced(x["text"], x["spans"], by))


def _replaced(text: Column, spans: Column, by) -> Column:
    ends = F.transform(spans, lambda s: s["end"])
    cut = lambda b: F.struct(F.slice(spans, b * BLOCK + 1, F.lit(BLOCK)).alias("spans"), F.coalesce(F.array_max(F.slice(ends, F.lit(1), b * BLOCK)), F.lit(0)).alias("at"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), cut)
    blocks = F.transform(blocks, lambda b: F.struct(b["spans"], b["at"], F.substring(text, b["at"] + 1, F.array_max(F.transform(b["spans"], lambda s: s["end"])) - b["at"]).alias("text")))

    def parts(b: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            begin = F.greatest(s["start"], acc["at"])
            piece = F.concat(F.substring(b["text"], acc["at"] - b["at"] + 1, begin - acc["at"]), by(s, begin, s["start"] >= acc["at"]))
            return F.when(s["end"] > acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(piece)).alias("parts"))).otherwise(acc)

        return F.aggregate(b["spans"], F.struct(b["at"].alias("at"), F.array().cast("array<string>").alias("parts")), step)["parts"]

    tail = F.substring(text, F.array_max(ends) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(F.flatten(F.transform(blocks, parts)), ""), tail)).otherwise(text)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with masked texts, all columns and rows kept, whatever their names; null texts stay null, odd rows as in ``sanitise``.

    Base spans are found again while the texts are read; only the few rows with disclosing terms are joined.
    """
    terms = sanitise(docs).where(F.size("terms") > 0).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "terms")
    terms = stage(terms.dropDuplicates(["__id", "__hash"]), "disclosing")
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.xxhash64(F.col(text).cast("string")).alias("__h"), F.col(text).cast("string").alias("__text"))
    found = base_spans(named, "__text").join(bounded(terms, 100_000), F.col("__row.doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left")
    found = found.withColumn("terms", F.coalesce("terms", F.array().cast(TERMS)))
    return found.withColumn("__text", replaced(F.col("__text"), all_spans(), label)).select(*(F.col("__text").alias(c) if c == text else F.col(f"__row.`{c}`") for c in docs.columns))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of all documents; odd rows as in ``sanitise``."""
    out = sanitise(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(count(k) for k in KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(all_spans()).alias("spans"))
