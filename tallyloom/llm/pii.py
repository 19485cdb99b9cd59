"""Personal data: fixed kinds found by pattern, and terms that give a protected entity away."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyloom.llm.common import row_key, stored

KINDS = ("email", "ip", "card", "phone", "term")

# Fixed patterns. A look-behind that only keeps a search from starting inside a
# run of digits changes no match: a start further right in the run fails alike.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = r"\p{L}{2,}"  # runs of letters, lower-cased: the one rule by which terms are counted and found

SUPPORT = 2  # texts that have to name an entity before terms around it are counted for it
NAMED = 4  # pieces of evidence that a part of the entity's own text counts for
CONFIDENCE = 1.645  # standard errors that an estimate is lowered by: one-sided, 95 %
DISCLOSES = 0.5  # chance, by that lower bound, with which a term may not tell the entity
REMOVES = 0.6  # from this chance on a term is removed, below it is generalised


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @, and a domain of two labels or more.

    A match begins where the run of local characters before its @ begins, or
    where the match before it ended, so looking at each @ once is enough.
    """
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind index, end, kind) of the four fixed kinds, in order of start, then kind."""
    found = [(start, 0, end) for start, end in emails(text)] if "@" in text else []
    for match in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in match[0].split(".")):
            found.append((match.start(), 1, match.end()))
    for match in CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((match.start(), 2, match.end()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in match[0]) <= 15:
                found.append((match.start(), 3, match.end()))
    return [(start, kind, end, KINDS[kind]) for start, kind, end in sorted(found)]


def parts(entity: str) -> set[str]:
    """Terms that a part of an address spells out."""
    import regex

    return {w for w in regex.findall(r"\p{L}{3,}", entity.split(":", 1)[1].split("@")[0])} if entity.startswith("email:") else set()


def terms_of(text: str, spans: list[tuple[int, int, str]]) -> dict[str, tuple[set[int], list[dict]]]:
    """Term -> (hashes of its neighbours, its places outside ``spans``), over the whole text."""
    import regex
    import xxhash

    out: dict[str, tuple[set[int], list[dict]]] = {}
    words = [(m[0].lower(), *m.span()) for m in regex.finditer(TERM, text)]
    covered = iter([*((start, end) for start, _, end, _ in spans), (len(text) + 1, len(text) + 1)])
    start, end = next(covered)
    for i, (word, first, last) in enumerate(words):
        while end <= first:
            start, end = next(covered)
        if start < last:
            continue
        near, places = out.setdefault(word, (set(), []))
        places.append({"start": first, "stop": last})
        before, after = words[i - 1][0] if i else "", words[i + 1][0] if i + 1 < len(words) else ""
        near.add(xxhash.xxh64_intdigest(f"{before} {after}".encode()) >> 1)
    return out


FOUND = (
    "n_email long, n_ip long, n_card long, n_phone long, base string, body long, entities array<string>, own array<struct<entity:string, term:string>>, "
    "terms array<struct<term:string, near:array<long>, places:array<struct<start:int, stop:int>>>>"
)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the fixed kinds and their spans; where there are any, the entities and the text's terms.

    A null text is empty. Terms come with the hashes of all that stands beside
    them and with all their places outside the spans; ``own`` are those
    that an entity spells out. Documents without an entity have none of that.
    """
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    kinds = {
        "entities": pa.list_(pa.string()),
        "own": pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())])),
        "terms": pa.list_(pa.struct([("term", pa.string()), ("near", pa.list_(pa.int64())), ("places", pa.list_(span))])),
    }

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            base, body, found = [], [], {name: [] for name in kinds}
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                for kind in range(4):
                    counts[kind].append(sum(s[1] == kind for s in spans))
                base.append(",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans))
                body.append(xxhash.xxh64_intdigest(text.encode()) >> 1 if spans else 0)
                entities = sorted({f"{KINDS[kind]}:{text[start:end].lower()}" for start, kind, end, _ in spans})
                terms = terms_of(text, spans) if spans else {}
                found["entities"].append(entities)
                found["own"].append([{"entity": e, "term": t} for e in entities for t in sorted(parts(e) & terms.keys())])
                found["terms"].append([{"term": t, "near": sorted(near), "places": places} for t, (near, places) in terms.items()])
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(body, pa.int64())]
            columns += [pa.array(found[name], kind) for name, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "body", *kinds])

    rows = docs.select("doc_id", "text").mapInArrow(look, f"doc_id {dict(docs.dtypes)['doc_id']}, {FOUND}")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "personal")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): the number of documents of the whole corpus that hold each term."""
    terms = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({TERM})"), F.lit(1))), F.lower))
    return docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def lower_bound(hits: Column, trials: Column, evidence: Column) -> Column:
    """Wilson's lower bound of the rate hits / trials as ``evidence`` independent pieces support it."""
    rate, z = F.least(hits / trials, F.lit(1.0)), F.lit(CONFIDENCE)
    spread = z * F.sqrt(rate * (1 - rate) / evidence + z * z / (4 * evidence * evidence))
    return (rate + z * z / (2 * evidence) - spread) / (1 + z * z / evidence)


def disclosing(found: DataFrame, docs: DataFrame, support: int = SUPPORT, discloses: float = DISCLOSES) -> DataFrame:
    """(entity, term, share): terms that tell an entity with a chance of at least ``discloses``.

    The chance that a document with the term names the entity is estimated from
    the corpus: documents with both, over all documents with the term. What
    that rests on are different texts and different neighbourhoods of the term,
    whichever are fewer, so that copies, near or exact, are one piece of
    evidence; the estimate is lowered accordingly. A part of an address counts
    as NAMED further pieces, which lets rare entities be told by their names,
    as long as few other documents hold that name.

    A term met with an entity is counted for it only if at least half of its
    documents name any entity at all, and for entities that ``support``
    different texts name: no other pair can reach the threshold.

    Spark sizes terms after an explode, and counted terms in a file, at a
    fraction of what they are in memory, so their joins are merged; ``likely``
    is what few terms are left.
    """
    named = found.where(F.size("entities") > 0).select("row", "body", "entities", "own", "terms")
    terms = named.select("row", "body", F.explode("terms").alias("t")).select("row", "body", "t.term", "t.near")
    among = terms.groupBy("term").agg(F.count("*").alias("bearing"))
    counted = stored(among.join(document_frequencies(docs), "term"), "counted")  # the corpus is read for it, once
    likely = stored(counted.where((F.col("bearing") >= discloses * F.col("df")) & (F.col("bearing") >= support)).select("term", "df"), "likely")
    entities = named.select("row", "body", F.explode("entities").alias("entity"))
    often = entities.groupBy("entity").agg(F.count_distinct("body").alias("texts")).where(F.col("texts") >= support)
    met = entities.join(often, "entity").select("row", "entity").join(terms.join(likely, "term").hint("merge"), "row")
    met = met.select("entity", "term", "row", "body", "near", "df", F.lit(False).alias("own"))
    spelt = named.select("row", F.explode("own").alias("o")).select("row", "o.entity", "o.term").join(terms.hint("merge"), ["row", "term"])
    spelt = spelt.join(counted.select("term", "df").hint("merge"), "term").select("entity", "term", "row", "body", "near", "df", F.lit(True).alias("own"))
    both = met.unionByName(spelt).groupBy("entity", "term", "row", "body", "near", "df").agg(F.bool_or("own").alias("own"))
    pairs = both.select("*", F.explode("near").alias("beside")).groupBy("entity", "term").agg(
        F.count_distinct("row").alias("both"),
        F.count_distinct("body").alias("texts"),
        F.count_distinct("beside").alias("besides"),
        F.max("df").alias("df"),
        F.bool_or("own").alias("own"),
    )
    prior = F.when(F.col("own"), F.lit(NAMED)).otherwise(F.lit(0))
    evidence = (F.least("texts", "besides") + prior).cast("double")
    share = lower_bound(F.col("both") + prior, F.greatest("df", "both") + prior, evidence)
    return pairs.select("entity", "term", share.alias("share")).where(F.col("share") >= discloses)


def term_spans(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, terms): per document every place of the terms that disclose an entity it names.

    Places are merged: Spark takes them, exploded, for small.
    """
    named = found.select("row", F.explode("entities").alias("entity")).join(terms, "entity")
    worst = named.groupBy("row", "term").agg(F.max("share").alias("share"))
    places = found.where(F.size("entities") > 0).select("row", F.explode("terms").alias("t")).select("row", "t.term", "t.places")
    hits = places.hint("merge").join(worst, ["row", "term"]).select("row", "share", F.explode("places").alias("p"))
    return hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("p.start", "p.stop", "share"))).alias("terms"))


def personal(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base spans and all spans of every row of ``docs`` (doc_id, text, ...).

    Null and empty texts have no spans and the digest of the empty string.
    Repeated rows give a row each, an empty table none. Terms are named in
    documents that name the entity; documents without one stay as they are.
    """
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = found.drop("terms").join(term_spans(found, disclosing(found, docs)), "row", "left")
    base = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(
            F.split(s, ":")[1].cast("int").alias("start"),
            F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]).cast("int").alias("kind"),
            s.alias("span"),
        ),
    )
    term = F.transform(
        F.coalesce("terms", F.array().cast("array<struct<start:int,stop:int,share:double>>")),
        lambda t: F.struct(t.start.alias("start"), F.lit(len(KINDS)).alias("kind"), F.concat_ws(":", F.lit("term"), t.start, t.stop).alias("span")),
    )
    spans = F.array_join(F.transform(F.array_sort(F.concat(base, term)), lambda s: s.span), ",")
    return rows.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans")
    )


def _cleaned(text: str | None, terms: list | None) -> str | None:
    if not text:
        return text
    cuts = [(start, end, f"[{kind.upper()}]") for start, _, end, kind in base_spans(text)]
    for term in terms if terms is not None else []:
        word = text[term["start"] : term["stop"]]
        shape = "[NAME]" if word[:1].isupper() else "[WORD]"
        cuts.append((term["start"], term["stop"], "[REMOVED]" if term["share"] >= REMOVES else shape))
    out, at = [], 0
    for start, end, mark in sorted(cuts):
        if end <= at:
            continue
        out += [text[at:start], mark] if start >= at else []
        at = end
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, personal data in ``text`` replaced and ``n_chars`` counted anew.

    Base spans become their kind in brackets; a disclosing term is removed, or
    generalised where it tells the entity with less chance than REMOVES. Every row stays.
    """

    @pandas_udf("string")
    def clean(text: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([_cleaned(t, own) for t, own in zip(text, terms, strict=True)], dtype=object)

    rows = docs.withColumn("__row", row_key(docs))
    found = scan(rows.select(F.col("__row").alias("doc_id"), "text"))
    spans = term_spans(found, disclosing(found, docs))
    none = F.array().cast("array<struct<start:int,stop:int,share:double>>")
    marked = found.where("base <> ''").select("row", F.col("doc_id").alias("__row")).dropDuplicates(["__row"]).join(spans, "row", "left")
    left = rows.join(marked.select("__row", F.coalesce("terms", none).alias("__terms")), "__row", "left")
    named = F.when(F.col("__terms").isNotNull(), F.col("text"))  # other texts need not go to Python
    text = F.coalesce(clean(named, "__terms"), F.col("text"))
    out = left.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
