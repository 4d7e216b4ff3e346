"""Personal data, and the terms whose company gives it away.

Four kinds are found by their form: e-mail and IP addresses, card and phone numbers. Their
distinct values are the protected entities. A term reveals an entity to the extent that,
over the corpus, whoever reads the term can tell the entity: with pointwise mutual
information PMI(e; t) and information content IC(e), what stays unknown is
IC(e) - PMI(e; t) = -log2 P(e | t) bits. Terms that leave at most one bit are removed, those
that leave at most two are generalised to what kind of term they are, wherever they stand.

Co-occurrence is counted within a window of terms around the entity, and only counts as
evidence if enough different windows show it. Windows count as one if the least hash of
their pairs of neighbouring terms is the same, as in copies and in most near copies of a text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decilog.llm.common import ROW, Scratch, if_small, keyed_rows, need

#: Fixed values of the contract: the kinds in their order; the method's own kind comes last.
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile("[^0-9]+")
#: A term is a run of ASCII letters and digits and of characters beyond ASCII; A-Z count as a-z.
TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
#: Terms on either side of an entity that are in its company, and different windows that are evidence.
NEAR, EVIDENCE = 8, 3
#: Bits left unknown up to which a term is removed, and up to which it is generalised.
REMOVE, GENERALISE = 1.0, 2.0
#: Revealing terms up to which every task holds all of them.
MOST = 200_000
#: Terms that a worker counts before it hands their counts on.
HELD = 400_000

Span = tuple[int, int, int]  # start, place in KINDS, end


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    twice = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(twice)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, in time linear in the text: each ``@`` takes what stands before it, back to the last match or ``@``."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL_PART))
        free = at + 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Spans of the four kinds, each kind leftmost and without overlaps of its own, by start and kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(start, 0, end) for start, end in emails(text)]
    for m in IP.finditer(text):
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in (p.lstrip("0") for p in m.group().split("."))):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGITS.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def value_of(text: str, span: Span) -> str:
    """What an entity is known by: its kind and value, whatever its case, blanks and marks."""
    start, kind, end = span
    value = text[start:end]
    return f"{KINDS[kind]}:" + (value.lower() if kind == 0 else value if kind == 1 else NOT_DIGITS.sub("", value))


def terms_of(text: str, base: list[Span]) -> list[tuple[int, int, str]]:
    """(start, end, term) of all terms that no base span touches."""
    covered: list[tuple[int, int]] = []
    for start, _, end in base:
        if covered and start <= covered[-1][1]:
            covered[-1] = covered[-1][0], max(end, covered[-1][1])
        else:
            covered.append((start, end))
    ends = [e for _, e in covered]
    found = []
    for m in TERM.finditer(text):
        k = bisect_right(ends, m.start())
        if k == len(covered) or covered[k][0] >= m.end():
            found.append((m.start(), m.end(), m.group().translate(LOWER)))
    return found


def company(docs: DataFrame) -> DataFrame:
    """entity, term, window, fresh: the terms near each entity; ``fresh`` is 1 once per document, entity and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, str, int, int]] = []
            for value in batch.column(0):
                text = value.as_py() or ""
                base = base_spans(text)
                if not base:
                    continue
                terms = terms_of(text, base)
                starts, met = [t[0] for t in terms], set()
                for span in base:
                    entity, left, right = value_of(text, span), bisect_left(starts, span[0]), bisect_left(starts, span[2])
                    near = [t[2] for t in terms[max(0, left - NEAR) : left]], [t[2] for t in terms[right : right + NEAR]]
                    pairs = [f"{a} {b}" for side in near for a, b in zip(side, side[1:])] or [" ".join([*near[0], *near[1]])]
                    window = min(map(xxhash.xxh64_intdigest, pairs)) - (1 << 63)
                    for term in {*near[0], *near[1]}:
                        rows.append((entity, term, window, int((entity, term) not in met)))
                        met.add((entity, term))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, [pa.string(), pa.string(), pa.int64(), pa.int64()])]
            yield pa.RecordBatch.from_arrays(columns, ["entity", "term", "window", "fresh"])

    return docs.select("text").mapInArrow(run, "entity string, term string, window long, fresh long")


def rows_with(docs: DataFrame) -> DataFrame:
    """term, docs: the rows that have each term, counted ahead in the workers: terms repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            terms = list(counts)
            for k in range(0, len(terms), 50_000):
                part = terms[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in part], pa.int64())], ["term", "docs"])
            counts.clear()

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.update(set((text.as_py() or b"").translate(TERM_BYTES).split()))
            if len(counts) > HELD:
                yield from out()
        yield from out()

    return docs.select("text").mapInArrow(run, "term string, docs long")


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return need(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def disclosures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", evidence: int = EVIDENCE, generalise: float = GENERALISE, left: Scratch | None = None) -> DataFrame:
    """entity, term, both, docs, bits: what terms leave unknown of an entity, where it is at most ``generalise`` bits.

    both: rows that have the term within the entity's window; docs: rows that have the term
    anywhere; bits = log2(docs / both), which is IC - PMI. Pairs that fewer than ``evidence``
    different windows show are left out.
    """
    rows, left = texts(docs, id_col, text_col), left or Scratch()
    near = company(rows).groupBy("entity", "term").agg(F.sum("fresh").alias("both"), F.count_distinct("window").alias("windows"))
    near = left.stage(near.where(F.col("windows") >= evidence).drop("windows"), "pii-company")
    asked = if_small(near.select("term").distinct(), MOST)
    counts = rows_with(rows).join(asked, "term", "left_semi").groupBy("term").agg(F.sum("docs").alias("docs"))
    return near.join(counts, "term").select("entity", "term", "both", "docs", F.log2(F.col("docs") / F.col("both")).alias("bits")).where(F.col("bits") <= generalise)


def revealing(docs: DataFrame, id_col: str, text_col: str, left: Scratch) -> DataFrame:
    """term, gone: the terms to remove (true) or to generalise, by the entity that each gives away most."""
    found = disclosures(docs, id_col, text_col, left=left)
    return left.stage(found.groupBy("term").agg((F.min("bits") <= REMOVE).alias("gone")), "pii-terms")


def with_own_terms(rows: DataFrame, terms: DataFrame, left: Scratch) -> tuple[DataFrame, dict[str, bool] | None]:
    """``rows`` with a map ``own`` of the revealing terms in each; null, and all terms at hand, where these are few."""
    if terms.limit(MOST + 1).count() <= MOST:
        return rows.withColumn("own", F.lit(None).cast("map<string, boolean>")), {r.term: r.gone for r in terms.collect()}  # bounded
    keyed = keyed_rows(rows, "pii-rows", left)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    there = keyed.select(ROW, F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(r"[0-9a-z\x{80}-\x{10FFFF}]+"), F.lit(0)))).alias("term"))
    own = there.join(terms, "term").groupBy(ROW).agg(F.map_from_entries(F.collect_list(F.struct("term", "gone"))).alias("own"))
    return keyed.join(own, ROW, "left").select(*rows.columns, "own"), None


def all_spans(text: str, known: dict[str, bool]) -> tuple[list[Span], list[Span]]:
    """The base spans, and those with the spans of revealing terms."""
    base = base_spans(text)
    if known and not known.keys().isdisjoint(w.decode() for w in set(text.encode().translate(TERM_BYTES).split())):
        return base, sorted([*base, *((start, 4, end) for start, end, term in terms_of(text, base) if term in known)])
    return base, base


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _found(rows: DataFrame, terms: DataFrame, left: Scratch, columns: dict[str, tuple[pa.DataType, str]], of_row) -> DataFrame:
    """One row per row: doc_id, and what ``of_row`` makes of the text, its base spans, all spans and the revealing terms."""
    rows, everywhere = with_own_terms(rows, terms, left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, own in zip(batch.column(1), batch.column(2)):
                text, known = text.as_py() or "", everywhere if everywhere is not None else dict(own.as_py() or ())
                made.append(of_row(text, *all_spans(text, known), known))
            arrays = [pa.array(c, kind) for c, (kind, _) in zip(zip(*made) if made else [[]] * len(columns), columns.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *columns])

    return rows.mapInArrow(run, ", ".join(["doc_id long", *[f"{c} {kind}" for c, (_, kind) in columns.items()]]))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", left: Scratch | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row.

    Spans are ``kind:start:end`` in code points, by start, then kind, joined by commas; the
    digest is of the base kinds alone, ``spans`` has those and the revealing terms. Null and
    empty texts have none (the digest of nothing). Null and repeated ids keep their rows; an
    empty table gives no rows; other columns are not read.
    """
    left = left or Scratch()

    def of_row(text: str, base: list[Span], spans: list[Span], known: dict[str, bool]) -> tuple:
        kinds = Counter(s[1] for s in base)
        return *(kinds[k] for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)

    columns = {c: (pa.int64(), "long") for c in ("n_email", "n_ip", "n_card", "n_phone")} | {c: (pa.string(), "string") for c in ("base_sha256", "spans")}
    return _found(texts(docs, id_col, text_col), revealing(docs, id_col, text_col, left), left, columns, of_row)


def kind_of(term: str) -> str:
    """What a generalised term still tells: a number, a name, or a word."""
    return "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[WORD]"


def cleaned(text: str, spans: list[Span], known: dict[str, bool]) -> str:
    """The text with its spans replaced; spans that overlap make way together, named by the first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            word = text[start:end]
            out += [text[at:start], f"[{KINDS[kind].upper()}]" if kind < 4 else "[REMOVED]" if known[word.translate(LOWER)] else kind_of(word)]
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", left: Scratch | None = None) -> DataFrame:
    """doc_id, text with personal data replaced by its kind and revealing terms removed or generalised, n_spans. Null texts become empty."""
    left = left or Scratch()
    columns = {"text": (pa.string(), "string"), "n_spans": (pa.int64(), "long")}
    return _found(texts(docs, id_col, text_col), revealing(docs, id_col, text_col, left), left, columns, lambda text, base, spans, known: (cleaned(text, spans, known), len(spans)))
