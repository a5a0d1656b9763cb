"""Problem 8: personal information in free text, found by what the terms of the corpus disclose, and replaced.

Information-theoretic sanitisation.  Patterns propose sites (``pii_patterns``).  From all sites of the corpus it is
counted how often each term - the words on either side, the form of a number, the parts of a name - occurs at a site,
and how often together with a protected entity.  Both give the term's disclosure: how many bits it adds to the odds
that the site holds an entity of that kind.  The first counts know only entities that are certain by themselves (a
number with its country code or label, an address with a post code, a name on the staff list); each further round
counts with what the round before found.  A site whose terms disclose more than the threshold is generalised to a
placeholder of its kind; everything else stays as it is.

The counts of all terms stay on Spark.  Texts are dealt into blocks; each block asks for the bits of the terms it has, by a
join on the term, and decides with those alone.  A term that is in most texts is asked for once a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

from .pii_patterns import (
    KINDS, Site, address_sites, capital_name_sites, email_sites, lower_name_sites, lower_words, number_sites, plain,
    term_key, upper_name_sites,
)

#: Characters of the texts of a block, which a task holds at a time with their sites; a longer text is a block of its own.
BLOCK_CHARS = 1 << 20
#: Bits a single term can add or take, and observations of ignorance added to each term.
MOST_BITS = 7.0
PRIOR_WEIGHT = 3.0
#: So many bits against an entity count even while only certain entities are known.
HARDLY_BITS = 3.5
#: A more special term is used from this number of sites on.
LEAST_SITES = 4
ROUNDS = 3
#: Bits above even odds from which a site is an entity: numbers and addresses go early, since their prior is learned from
#: those that are certain, a part of all.
THRESHOLD = {"email": 0.0, "phone": -3.5, "id_number": -3.5, "address": -2.0, "name": 0.0}
#: Most names of the staff list; it is checked before it is sent to the tasks.
MAX_KNOWN = 1_000_000
#: Terms that tell a name part and are sent to all tasks; where there are more, each block asks for those of its words.
MAX_NAME_TERMS = 262_144
#: Bits from which a word is known as a part of names.
NAME_BITS = 2.0
#: Terms a task counts before it emits them.
FLUSH_TERMS = 1_000_000
GROUPS = {"email": ("email",), "number": ("phone", "id_number"), "lettered": ("id_number",), "address": ("address",), "name": ("name",)}
EMPTY = term_key("")
PLACEHOLDER = {kind: f"[{kind.upper()}]" for kind in KINDS}


class Learned(NamedTuple):
    """The bits of every term of the corpus (``term, sites, bits_first, bits_second``), and the prior bits per kind."""

    bits: DataFrame
    prior: dict[tuple[str, str], float]
    first: bool


class Disclosure:
    """Bits per term and kind, of the terms of one block; the prior bits per kind.

    The first model is learned from entities that are certain by form or by the staff list, so in it the form tells
    nothing, and that a name isn't on the list tells nothing against it.
    """

    def __init__(self, keys: np.ndarray, sites: np.ndarray, bits: np.ndarray, prior: dict[tuple[str, str], float], first: bool):
        self.of = {k: (n, b) for k, n, b in zip(keys.tolist(), sites.tolist(), bits.tolist(), strict=True)}
        self.prior, self.first = prior, first

    def score(self, site: Site) -> dict[str, float]:
        """Per kind the site can be, the bits by which its odds are above even."""
        kinds = GROUPS[site.group]
        total = [self.prior[site.group, k] for k in kinds]
        for part, chain in enumerate(site.chains):
            for place, term in enumerate(chain):
                found = self.of.get(term)
                if found is not None and (found[0] >= LEAST_SITES or place == len(chain) - 1):
                    other = part == 0 and site.group == "number" and found[1][0] > 1
                    for i in range(len(kinds)):
                        total[i] += found[1][i] if other else self.taken(kinds[i], part, found[1][i])
                    break
        return dict(zip(kinds, total, strict=True))

    def taken(self, kind: str, part: int, bits: float) -> float:
        """What of a term's bits counts; part is the place of its chain in the site."""
        if not self.first:
            return bits
        if kind == "id_number":
            # Its seeds are labelled: a missing label on the left tells nothing against it (unless phone numbers stand
            # there), nor do the form and what follows unless they hardly ever come with a label.
            return bits if part and bits < -HARDLY_BITS else max(0.0, bits)
        return 0.0 if part == 2 else max(0.0, bits) if part > 2 else bits

    def knows(self, kind: str, word: str) -> bool:
        """Whether a word is known as a given (`g`) or family (`f`) name rather than as another word."""
        found = self.of.get(term_key(f"p.{kind} {word}"))
        return found is not None and found[1][0] > NAME_BITS


def decide(sites: list[Site], model: Disclosure) -> list[tuple[float, str, Site]]:
    """The entities among the sites of a text: above the threshold, and of overlapping ones that with the most bits.

    An e-mail address or street address goes before a name or number inside it.
    """
    likely = []
    for site in sites:
        kind, bits = max(model.score(site).items(), key=lambda x: x[1])
        if bits > THRESHOLD[kind]:
            likely.append((kind in ("email", "address"), bits, site.end - site.start, kind, site))
    likely.sort(key=lambda x: (-x[0], -x[1], -x[2], x[4].start))
    taken: list[tuple[float, str, Site]] = []
    for _, bits, _, kind, site in likely:
        if all(site.end <= other.start or other.end <= site.start for _, _, other in taken):
            taken.append((bits, kind, site))
    return sorted(taken, key=lambda x: x[2].start)


SITE = "kind:string,start:int,stop:int,seeds:array<string>,chains:array<array<bigint>>"
#: The sites before ``firm`` don't depend on a model; those from it on are lower-case names.
TEXTS = f"block long, doc_id string, text string, firm int, sites array<struct<{SITE}>>"
COUNTS = "kind string, term long, sites long, first long, second long"


def _packed(site: Site) -> dict:
    return {"kind": site.group, "start": site.start, "stop": site.end, "seeds": list(site.seeds), "chains": site.chains}


def _unpacked(row) -> list[Site]:
    return [Site(x["kind"], x["start"], x["stop"], [np.asarray(c).tolist() for c in x["chains"]], tuple(x["seeds"])) for x in row]


def _all_sites(known: dict[str, set[str]]):
    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = []
            for doc, text in batch.itertuples(index=False, name=None):
                if held and held + len(text) > BLOCK_CHARS:
                    block, held = block + 1, 0
                held += len(text)
                flat = plain(text)[0]
                firm = [*email_sites(flat), *number_sites(flat), *address_sites(flat), *capital_name_sites(flat, known)]
                lower = lower_name_sites(flat, known)
                rows.append((block, doc, text, len(firm), [_packed(s) for s in (*firm, *lower)]))
            yield pd.DataFrame(rows, columns=["block", "doc_id", "text", "firm", "sites"])

    return propose


def _name_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The terms by which a model knows the lower-case words of the texts as names."""
    for batch in batches:
        asked = set()
        for block, texts in batch.groupby("block")["text"]:
            words = {w for text in texts for w in lower_words(plain(text)[0])}
            asked |= {(block, term_key(f"p.{kind} {w}")) for w in words for kind in "gf"}
        yield pd.DataFrame(list(asked), columns=["block", "term"])


def _by_block(
    rows: DataFrame, terms: DataFrame, model: Learned, work: Callable[[pd.DataFrame, Disclosure], pd.DataFrame], schema: str
) -> DataFrame:
    """``work`` on the rows of each block, with the bits of the terms (``block, term``) that the block asks for."""
    told = terms.select(F.col("block").alias("of"), "term").distinct().join(model.bits, "term")
    prior, first = model.prior, model.first

    def run(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        bits = known[["bits_first", "bits_second"]].to_numpy(np.float64)
        return work(own, Disclosure(known["term"].to_numpy(), known["sites"].to_numpy(), bits, prior, first))

    return rows.groupBy("block").cogroup(told.groupBy("of")).applyInPandas(run, schema)


def _terms(rows: DataFrame) -> DataFrame:
    return rows.select("block", F.explode(F.array_distinct(F.flatten(F.flatten("sites.chains")))).alias("term"))


def _count(batches: Iterator[pd.DataFrame], model: Disclosure | None = None) -> Iterator[pd.DataFrame]:
    counts: dict[tuple[str, int], list[int]] = {}

    def emit() -> pd.DataFrame:
        rows = [(g, t, n, a, b) for (g, t), (n, a, b) in counts.items()]
        counts.clear()
        return pd.DataFrame(rows, columns=["kind", "term", "sites", "first", "second"])

    for batch in batches:
        for row in batch["sites"]:
            sites = _unpacked(row)
            found = {}
            if model:
                found = {(s.group, s.start, s.end): kind for _, kind, s in decide(sites, model)}
            for site in sites:
                kinds = GROUPS[site.group]
                kind = found.get((site.group, site.start, site.end))
                hit = [int(k == kind or k in site.seeds) for k in kinds] + [0]
                # The group's own total stands under the empty term.
                for term in {EMPTY, *(t for chain in site.chains for t in chain)}:
                    entry = counts.get((site.group, term))
                    if entry is None:
                        entry = counts[site.group, term] = [0, 0, 0]
                    entry[0] += 1
                    entry[1] += hit[0]
                    entry[2] += hit[1]
        if len(counts) > FLUSH_TERMS:
            yield emit()
    yield emit()


def _learn(sites: DataFrame, model: Learned | None) -> Learned:
    """Count the terms of all sites and turn the counts into bits, those of every term seen twice or more."""
    if model is None:
        counted = sites.mapInPandas(_count, COUNTS)
    else:
        counted = _by_block(sites, _terms(sites), model, lambda rows, own: next(_count(iter([rows]), own)), COUNTS)
    counts = cut_lineage(
        counted.groupBy("kind", "term").agg(F.sum("sites").alias("sites"), F.sum("first").alias("first"), F.sum("second").alias("second"))
    )
    share = {}
    total = {r["kind"]: (r["sites"], r["first"], r["second"]) for r in counts.where(F.col("term") == EMPTY).collect()}
    for group, kinds in GROUPS.items():
        n, *hits = total.get(group, (0, 0, 0))
        for kind, hit in zip(kinds, hits, strict=False):
            share[group, kind] = min(max((hit + 0.5) / (n + 1), 1e-4), 0.95)
    columns = []
    for place, name in enumerate(("first", "second")):
        of = {g: share[g, k[place]] for g, k in GROUPS.items() if len(k) > place}
        p = F.coalesce(F.create_map(*(F.lit(x) for pair in of.items() for x in pair))[F.col("kind")], F.lit(0.5))
        odds = (F.col(name) + PRIOR_WEIGHT * p) / (F.col("sites") - F.col(name) + PRIOR_WEIGHT * (1 - p))
        bits = F.log2(odds / (p / (1 - p)))
        columns.append(F.greatest(F.lit(-MOST_BITS), F.least(F.lit(MOST_BITS), bits)).alias(f"bits_{name}"))
    prior = {k: float(np.log2(p / (1 - p))) for k, p in share.items()}
    bits = counts.where((F.col("sites") >= 2) & (F.col("term") != EMPTY)).select("term", "sites", *columns)
    return Learned(bits, prior, model is None)


def known_parts(names: DataFrame) -> dict[str, set[str]]:
    """Given and family names of a staff list (name_part, part_kind), a short table whose size is checked."""
    rows = names.where("name_part is not null").select("name_part", "part_kind").distinct().limit(MAX_KNOWN + 1).collect()
    if len(rows) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known names: a staff list is expected")
    out: dict[str, set[str]] = {"given": set(), "family": set()}
    for part, kind in rows:
        out.setdefault(kind, set()).add(plain(part)[0].lower())
    return out


def _final_sites(documents: DataFrame, names: DataFrame, rounds: int) -> tuple[DataFrame, Learned]:
    """The sites of all texts (``block, doc_id, text, sites``) and what the corpus tells about their terms.

    ``at`` and ``to`` of a site are its places in the text itself.
    """
    known = known_parts(names)
    texts = documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").where("length(text) > 0")
    texts = cut_lineage(texts.mapInPandas(_all_sites(known), TEXTS))
    sites = texts.where("size(sites) > 0").select("block", "sites")
    model: Learned | None = None
    for _ in range(rounds):
        model = _learn(sites, model)

    def propose(rows: pd.DataFrame, knows: Callable[[str, str], bool]) -> pd.DataFrame:
        final = []
        for text, firm, row in zip(rows["text"], rows["firm"], rows["sites"], strict=True):
            flat, places = plain(text)
            found = [*_unpacked(row[:firm]), *upper_name_sites(flat, known, knows), *lower_name_sites(flat, known, knows)]
            spans = [(s.start, s.end) if places is None else (places[s.start], places[s.end - 1] + 1) for s in found]
            final.append([_packed(s) | {"at": at, "to": to} for s, (at, to) in zip(found, spans, strict=True)])
        return rows[["block", "doc_id", "text"]].assign(sites=final)

    schema = f"block long, doc_id string, text string, sites array<struct<{SITE},at:int,to:int>>"
    parts = model.bits.where(F.col("bits_first") > NAME_BITS).select("term").limit(MAX_NAME_TERMS + 1).collect()
    if len(parts) > MAX_NAME_TERMS:
        words = texts.mapInPandas(_name_words, "block long, term long")
        return cut_lineage(_by_block(texts, words, model, lambda rows, own: propose(rows, cache(own.knows)), schema)), model
    terms = frozenset(r["term"] for r in parts)

    def propose_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        knows = lru_cache(1 << 18)(lambda kind, word: term_key(f"p.{kind} {word}") in terms)
        for batch in batches:
            yield propose(batch, knows)

    return cut_lineage(texts.mapInPandas(propose_all, schema)), model


def _entities(row, model: Disclosure) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, bits) of the entities among the sites of a text, as places in the text itself."""
    spans = {(x["start"], x["stop"]): (x["at"], x["to"]) for x in row}
    return [(*spans[s.start, s.end], kind, bits) for bits, kind, s in decide(_unpacked(row), model)]


def find_entities(documents: DataFrame, names: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, pii_type, start_at, end_at, bits``: every entity of every text, in characters from 0.

    Null and empty texts have none.  Rows repeating a doc_id count once; rows without a doc_id are left out.
    """
    sites, model = _final_sites(documents, names, rounds)

    def find(texts: pd.DataFrame, own: Disclosure) -> pd.DataFrame:
        rows = [
            (doc, kind, start, end, bits)
            for doc, row in zip(texts["doc_id"], texts["sites"], strict=True)
            for start, end, kind, bits in _entities(row, own)
        ]
        return pd.DataFrame(rows, columns=["doc_id", "pii_type", "start_at", "end_at", "bits"])

    sites = sites.where("doc_id is not null and size(sites) > 0").select("block", "doc_id", "sites")
    schema = "doc_id string, pii_type string, start_at int, end_at int, bits double"
    found = _by_block(sites, _terms(sites), model, find, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast("long")).dropDuplicates(["doc_id", "pii_type", "start_at"])


def sanitise(documents: DataFrame, names: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, text, replaced``: each text with its entities as placeholders, all other characters unchanged.

    Null and empty texts stay as they are; every row stays a row.
    """
    sites, model = _final_sites(documents, names, rounds)

    def mask(texts: pd.DataFrame, own: Disclosure) -> pd.DataFrame:
        rows = []
        for doc, text, row in zip(texts["doc_id"], texts["text"], texts["sites"], strict=True):
            parts, at, n = [], 0, 0
            for start, end, kind, _ in _entities(row, own):
                parts += [text[at:start], PLACEHOLDER[kind]]
                at, n = end, n + 1
            rows.append((doc, "".join([*parts, text[at:]]), n))
        return pd.DataFrame(rows, columns=["doc_id", "text", "replaced"])

    masked = _by_block(sites, _terms(sites), model, mask, "doc_id string, text string, replaced int")
    empty = documents.where("text is null or length(text) = 0")
    return masked.withColumn("doc_id", F.col("doc_id").cast("long")).unionByName(
        empty.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).alias("replaced"))
    )
