"""Information-theoretic sanitisation of personal data.

Patterns find protected entities (mail and IP addresses, card and phone
numbers). A line is a context; terms are runs of letters, marks and digits, in
lower case, without punctuation around them. The terms within ``WINDOW`` code
points of an entity and outside all entities stand with it. Over the whole
corpus, ``log2(N n_te / ((n_t + 1) n_e))``, the pointwise mutual information with
one more context of the term assumed, says how much a term reveals of an entity,
whose whole information is ``log2(N / n_e)``. A term discloses the entity if it
reveals ``DISCLOSURE`` of that and leaves ``BITS_LEFT`` at most: with the added
context, a reader who knows the term guesses the entity right every second time.
So a name written once, beside an address written once, counts, and a word that
mostly stands elsewhere does not, however large the corpus. A disclosing term
goes from all documents: it is removed if all its lines hold it beside that
entity, else generalised by its form to ``[NUMBER]``, ``[NAME]`` or ``[TERM]``.

DataFrame functions only. Positions are code points, ends exclusive: the pieces
between matches and the matches themselves have the lengths that add up to
them. Patterns are anchored where a run of their first class begins, or where
the last match ended, and possessive, so that time and stack stay bounded on
very long runs; they find what the plain patterns find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import SPACE, stage, text_hash, text_or_empty

DISCLOSURE = 0.9
BITS_LEFT = 1.0
WINDOW = 60
WORD = r"\p{L}\p{M}\p{N}"

KINDS = ["email", "ip", "card", "phone", "term"]
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?={LOCAL})(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,instead:string>>"
STEP = 256  # matches whose positions are summed one after the other


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def is_ip(m: Column) -> Column:
    """Four numbers of 255 at most, whatever zeros they begin with."""
    short = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.lpad(short(p), 3, "0") <= "255"))


def is_card(m: Column) -> Column:
    d = F.reverse(digits(m))

    def luhn(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return (F.when(F.length(d).between(14, 19),
                   F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), luhn) % 10 == 0)
            .otherwise(F.lit(False)))


def is_phone(m: Column) -> Column:
    return F.length(digits(m)).between(10, 15)


def spans_of(text: Column, pattern: Column, kind: str, valid=None, instead=None) -> Column:
    """Spans of the valid matches, leftmost and without overlap, in order."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    empty = F.array().cast(SPAN)
    replaced = instead or (lambda m: F.lit(f"[{kind.upper()}]"))

    def placed(begin: Column, pairs: Column) -> Column:
        """Spans of one step's (piece before, match) pairs, the text before them being ``begin`` long."""
        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["0"])
            end = start + F.length(x["1"])
            span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"),
                            replaced(x["1"]).alias("instead"))
            keep = F.lit(True) if valid is None else valid(x["1"])
            return F.struct(end.alias("at"), F.when(keep, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))
        return F.aggregate(pairs, F.struct(begin.alias("at"), empty.alias("out")), add, lambda acc: acc["out"])

    # steps begin at the sum of what stands before them, so time grows little faster than the number of matches
    pieces = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("0"), found.alias("1"))
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.size(found) / STEP).cast("int") - 1),
                        lambda i: F.slice(pairs, i * STEP + 1, F.lit(STEP)))
    sizes = F.transform(steps, lambda s: F.aggregate(
        s, F.lit(0).cast("long"), lambda n, x: n + F.length(x["0"]) + F.length(x["1"])))
    begins = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b))
    return F.when(F.size(found) > 0, F.flatten(F.zip_with(begins, steps, placed))).otherwise(empty)


def base_spans(text: Column) -> Column:
    """All spans of the four base kinds, by start, then kind."""
    no = F.array().cast(SPAN)
    email = F.when(F.contains(text, F.lit("@")), spans_of(text, F.lit(EMAIL), "email")).otherwise(no)
    phone = F.when(F.contains(text, F.lit("+")), spans_of(text, F.lit(PHONE), "phone", is_phone)).otherwise(no)
    return F.sort_array(F.concat(email, spans_of(text, F.lit(IP), "ip", is_ip),
                                 spans_of(text, F.lit(CARD), "card", is_card), phone))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text as they are written."""
    return F.array_remove(F.array_distinct(F.split(text, f"[^{WORD}]+")), "")


def _near(line: Column, found: Column) -> tuple[Column, Column]:
    """The line with its entities blanked, to be kept as ``bare``, and from it a
    struct (entity, terms) for each span in ``found``."""
    cut = lambda s, start, end: F.substring(s, (start + 1).cast("int"), (end - start).cast("int"))

    def blank(acc: Column, s: Column) -> Column:
        start = F.greatest(acc["at"], s["start"])
        end = F.greatest(acc["at"], s["end"])
        return F.struct(end.alias("at"), F.concat(acc["out"], cut(line, acc["at"], start),
                                                  F.repeat(F.lit(" "), (end - start).cast("int"))).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    bare = F.aggregate(found, zero, blank, lambda acc: F.concat(acc["out"], cut(line, acc["at"], F.length(line).cast("long"))))

    def of_span(s: Column) -> Column:
        # one more code point than the window shows whether a term is cut; such a one is left out
        far = s["start"] - WINDOW - 1
        before = F.when(far >= 0, F.regexp_replace(cut(F.col("bare"), far, s["start"]), f"^[{WORD}]+", "")).otherwise(
            cut(F.col("bare"), F.lit(0).cast("long"), s["start"]))
        behind = cut(F.col("bare"), s["end"], s["end"] + WINDOW + 1)
        behind = F.when(F.length(behind) > WINDOW, F.regexp_replace(behind, f"[{WORD}]++$", "")).otherwise(behind)
        entity = F.concat_ws(":", s["kind_no"].cast("string"), F.lower(cut(line, s["start"], s["end"])))
        return F.struct(entity.alias("entity"), terms_of(F.lower(F.concat_ws(" ", before, behind))).alias("terms"))
    return bare, F.transform(found, of_span)


def _mentions(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(entity, term) once for each line in which they stand together; a row
    with a null term for each line and entity."""
    with_some = base.filter(F.size("base") > 0).select("doc_id", "text_hash").distinct()
    lines = (docs.alias("d").join(with_some.alias("b").hint("shuffle_hash"), _same_row("d", "b"), "left_semi")
             .select(F.explode(F.split("text", "\n")).alias("line"))
             .withColumn("found", base_spans(F.col("line"))).filter(F.size("found") > 0))
    bare, near = _near(F.col("line"), F.col("found"))
    # a term counts where the whole line has it as a term too: nothing that only an entity's end cuts off
    pairs = F.flatten(F.transform(F.col("near"), lambda x: F.transform(
        F.array_append(F.array_intersect(x["terms"], F.col("held")), F.lit(None).cast("string")),
        lambda t: F.struct(x["entity"].alias("entity"), t.alias("term")))))
    return (lines.withColumn("bare", bare).select(near.alias("near"), terms_of(F.lower("line")).alias("held"))
            .select(F.explode(F.array_distinct(pairs)).alias("p")).select("p.entity", "p.term"))


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def disclosing_terms(docs: DataFrame, mentions: DataFrame, disclosure: float, bits_left: float) -> DataFrame:
    """(term, only_here): terms that disclose an entity."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    held = lines.select(F.explode(terms_of(F.lower("line"))).alias("term"))
    per_term = held.groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.agg(F.sum(F.size(F.split("text", "\n")).cast("long"))).first()[0] or 0
    per_pair = stage(mentions.groupBy("entity", "term").agg(F.count("*").alias("n")), "pii-pairs")
    per_entity = per_pair.filter("term is null").select("entity", F.col("n").alias("n_e"))
    together = per_pair.filter("term is not null").withColumnRenamed("n", "n_te")
    left = F.log2((F.col("n_t") + 1) / F.col("n_te"))
    whole = F.log2(F.lit(float(total)) / F.col("n_e"))
    # a hair's breadth for rounding, so that equal counts decide alike
    return (together.join(per_entity, "entity").join(per_term, "term")
            .filter((whole > 0) & (left <= bits_left + 1e-9) & (whole - left >= disclosure * whole - 1e-9))
            .groupBy("term").agg(F.min(F.col("n_t") == F.col("n_te")).alias("only_here")))


def general_form(term: Column) -> Column:
    """What stands for a generalised term."""
    return (F.when(term.rlike(r"\p{N}"), F.lit("[NUMBER]")).when(term.rlike(r"^\p{Lu}"), F.lit("[NAME]"))
            .otherwise(F.lit("[TERM]")))


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, bits_left: float = BITS_LEFT) -> DataFrame:
    """doc_id, text_hash, base and spans of each row of ``docs`` (doc_id, text).

    ``base`` has the pattern spans, ``spans`` those and the disclosing terms;
    each span has start, kind_no (of ``KINDS``), end and instead, its
    replacement. A disclosing term is marked wherever a document holds it, in
    any case of letters. A null text is empty and has no spans. Rows are told
    apart by id and text, so repeated and null ids do no harm.
    """
    docs = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_hash", text_hash())
    base = stage(docs.select("doc_id", "text_hash", base_spans(F.col("text")).alias("base")), "pii-base")
    terms = stage(disclosing_terms(docs, _mentions(docs, base), disclosure, bits_left), "pii-terms")
    # a term that very many documents hold may be split, as its other side is a written table
    held = (docs.select("doc_id", "text_hash", F.explode(terms_of(F.col("text"))).alias("written"))
            .withColumn("term", F.lower("written")).join(terms, "term"))
    per_row = stage(held.groupBy("doc_id", "text_hash", "only_here")
                    .agg(F.collect_set("written").alias("terms")), "pii-row-terms")
    pattern = F.concat(F.lit(f"(?<![{WORD}])(?:"), F.array_join("terms", "|"), F.lit(f")(?![{WORD}])"))
    found = (docs.alias("d").join(per_row.alias("t").hint("shuffle_hash"), _same_row("d", "t"))
             .select("d.doc_id", "d.text_hash", "only_here", spans_of(
                 F.col("text"), pattern, "term",
                 instead=lambda m: F.when(F.col("only_here"), F.lit("")).otherwise(general_form(m))).alias("found"))
             .groupBy("doc_id", "text_hash").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found")))
    spans = F.sort_array(F.concat("base", F.coalesce("found", F.array().cast(SPAN))))
    return (base.alias("b").join(found.alias("f"), _same_row("b", "f"), "left")
            .select("b.doc_id", "b.text_hash", "base", spans.alias("spans")))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span of ``text`` replaced; of overlapping spans the first counts."""
    found = find_personal_data(docs, **options).select("doc_id", "text_hash", F.col("spans").alias("__spans"))
    found = found.dropDuplicates(["doc_id", "text_hash"])

    def write(acc: Column, s: Column) -> Column:
        kept = F.substring(F.col("d.text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        new = F.when(s["start"] >= acc["at"], s["instead"]).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], kept, new).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    whole = F.aggregate("__spans", zero, write, lambda acc: F.concat(
        acc["out"], F.substring(F.col("d.text"), (acc["at"] + 1).cast("int"), F.length("d.text"))))
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64("d.text") == F.col("f.text_hash"))
    return (docs.withColumn("text", text_or_empty()).alias("d").join(found.alias("f"), same)
            .select(*[whole.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns]))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind_no"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
