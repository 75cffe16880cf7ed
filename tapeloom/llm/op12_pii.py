"""Personal data by patterns and a skip-chain conditional random field.

Patterns with validators give the base spans. On top of them every token with a digit, ``@`` or
``+`` is a variable of a conditional random field with the labels none, email, ip, card and phone;
all other tokens are none by rule. Tokens that stand side by side share chain potentials. Distant
tokens of a document that repeat or resemble one another (equal letters and digits, or the same
last seven digits) share skip potentials through a common hub variable, so their number of edges
grows with the tokens and never with pairs, and evidence is two hops away however far apart they
stand. Loopy sum-product message passing runs a fixed number of rounds over whole documents. Tokens
inside base spans are observed; runs of other tokens that end up with a label at ``SURE`` or more
are added. What is found thus depends on its document only, not on how the table is split.

Weights are learned here, without the base spans as features: labels are those of the base spans,
the criterion is the pseudo-likelihood (each token given its neighbours and the shares of labels
among its likenesses), over at most ``PER_LABEL`` tokens of each label, drawn by hash from all
documents; class frequencies are corrected for the drawing.

Defined results: a null text counts as empty and has no spans; rows are judged one by one, so
repeated rows and null ids are returned as they come; an empty table gives no rows, and a table
without personal data a model that adds nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import in_bytes, read
from tapeloom.plans.stage import written

#: Fixed values of the contract: kinds in their order, and the patterns of the base spans. Runs are
#: matched possessively and digits from their first one, which finds the same in linear time.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

NONE = 0
LABELS = 1 + len(KINDS)
#: Tokens drawn per label for training, and hashed features.
PER_LABEL, FEATURES = 2_000, 4_096
#: Rounds of message passing, share of the old message kept, and belief at which a token is added.
ROUNDS, KEPT, SURE = 25, 0.3, 0.9
#: Steps and step size of training, and the pull of weights to zero.
STEPS, RATE, DECAY = 200, 0.5, 1e-4
#: Weight of an observed label.
OBSERVED = 30.0
#: Characters of texts held as one graph.
SLICE = 4_000_000


def _luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches found from their ``@``: what stands before it can only be its whole run."""
    end = 0
    for found in _DOMAIN.finditer(text):
        start = found.start()
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < found.start():
            end = found.end()
            yield start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind index) by start, then kind."""
    spans = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    spans += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for found in _CARD.finditer(text):
        digits = _digits(found.group())
        if 14 <= len(digits) <= 19 and _luhn(digits):
            spans.append((*found.span(), 2))
    if "+" in text:
        spans += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(spans, key=lambda s: (s[0], s[2]))


_MARKED = re.compile(r"[0-9@+]\S*")
_TRAILING = re.compile(r"[^\w)]+$")
_LEADING = re.compile(r"^[^\w+(]+")
_PLAIN = re.compile(r"[^a-z0-9]+")


@dataclass
class Tokens:
    """The variables of some documents: cores, features, observed labels, chain links and hubs."""

    starts: list = field(default_factory=list)
    ends: list = field(default_factory=list)
    features: list = field(default_factory=list)
    labels: list = field(default_factory=list)
    chained: list = field(default_factory=list)
    members: list = field(default_factory=list)
    hubs: int = 0

    def add(self, text: str, spans: list[tuple[int, int, int]]) -> tuple[int, int]:
        """Append the tokens of one document; the bounds of its part."""
        first, end, at, alike, likely = len(self.starts), 0, 0, {}, sorted(spans)
        for found in _MARKED.finditer(text):
            start = found.start()
            while start > end and not text[start - 1].isspace():
                start -= 1
            whole, before = text[start : found.end()], end
            trailing, leading = _TRAILING.search(whole[-40:]), _LEADING.match(whole)
            a = start + (leading.end() if leading else 0)
            b = found.end() - (len(trailing.group()) if trailing else 0)
            end = found.end()
            if b <= a:
                continue
            while at < len(likely) and likely[at][1] <= a:
                at += 1
            # spans of several kinds may meet a token: the longest one names it
            met, ahead = [], at
            while ahead < len(likely) and likely[ahead][0] < b:
                if likely[ahead][1] > a:
                    met.append(likely[ahead])
                ahead += 1
            here = len(self.starts)
            near = here > first and start - before <= 2 and text[before:start].isspace()
            self.chained.append(near)
            core = text[a:b]
            self.starts.append(a)
            self.ends.append(b)
            self.features.append(_features(core, text[max(0, a - 40) : a], text[b : b + 40]))
            self.labels.append(max(met, key=lambda s: (s[1] - s[0], -s[2]))[2] + 1 if met else NONE)
            plain = _PLAIN.sub("", core[:256].lower())
            digits = _digits(plain)
            if len(plain) >= 5:
                alike.setdefault(plain, []).append(here)
            if len(digits) >= 7 and digits[-7:] != plain:
                alike.setdefault(digits[-7:], []).append(here)
        for group in alike.values():
            if len(group) > 1:
                self.members += [(token, self.hubs) for token in group]
                self.hubs += 1
        return first, len(self.starts)


def _hash(text: str) -> int:
    return 1 + zlib.crc32(text.encode("utf-8", "surrogatepass")) % (FEATURES - 1)


def _features(core: str, before: str, after: str) -> list[int]:
    """Hashed facts of a token that do not come from the base patterns, always as many; 0 is the constant."""
    shape, last, run = [], "", 0
    for c in core[:64]:
        kind = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if kind == last:
            run += 1
            continue
        shape.append(f"{last}{run}" if last == "9" else last)
        last, run = kind, 1
    shape.append(f"{last}{run}" if last == "9" else last)
    digits = _digits(core[:64])
    words, follow = before.split(), after.split()
    return [
        0,
        _hash("shape " + "".join(shape)),
        _hash("kinds " + "".join(sorted({s[0] for s in shape if s}))),
        _hash(f"digits {min(len(digits), 24)}"),
        _hash(f"sum {14 <= len(digits) <= 19 and len(core) - len(digits) <= 4 and _luhn(digits)}"),
        _hash(f"parts {core.count('.')} {all(len(p) < 4 and int(p) < 256 for p in core.split('.') if p.isdecimal() and p.isascii())}"),
        _hash("before " + (words[-1].lower() if words else "")),
        _hash("after " + (follow[0].lower() if follow else "")),
    ]


N_FEATURES = len(_features("0", "", ""))


@dataclass
class Model:
    """Log potentials: per feature and label, per pair of neighbours, and for agreeing with a likeness."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, tokens: Tokens) -> np.ndarray:
        """Marginals of all tokens by loopy message passing."""
        n = len(tokens.starts)
        local = self.unary[np.array(tokens.features)].sum(axis=1)
        labels = np.array(tokens.labels)
        known = np.flatnonzero(labels != NONE)
        local[known] = -OBSERVED
        local[known, labels[known]] = OBSERVED
        local = np.r_[local, np.zeros((tokens.hubs, LABELS))]
        right = np.flatnonzero(tokens.chained)
        members = np.array(tokens.members, np.int64).reshape(-1, 2)
        a = np.r_[right - 1, members[:, 0]]
        b = np.r_[right, members[:, 1] + n]
        edges = len(a)
        weights = np.r_[np.broadcast_to(self.chain, (len(right), LABELS, LABELS)), np.broadcast_to(np.diag(self.skip), (len(members), LABELS, LABELS))]
        both = np.r_[weights, weights.transpose(0, 2, 1)]
        source, target = np.r_[a, b], np.r_[b, a]
        back = np.r_[np.arange(edges, 2 * edges), np.arange(edges)]
        messages = np.zeros((2 * edges, LABELS))

        def summed():
            return local + np.column_stack([np.bincount(target, messages[:, k], len(local)) for k in range(LABELS)])

        for _ in range(ROUNDS if edges else 0):
            cavity = summed()[source] - messages[back]
            new = np.logaddexp.reduce(cavity[:, :, None] + both, axis=1)
            new -= new.max(axis=1, keepdims=True)
            messages = KEPT * messages + (1 - KEPT) * new
        total = summed()[:n] if edges else local[:n]
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)


def fit(labels: np.ndarray, features: np.ndarray, left: np.ndarray, right: np.ndarray, alike: np.ndarray, counts: np.ndarray) -> Model:
    """Weights that make each drawn token likely given its neighbours.

    ``left`` and ``right`` are labels of chain neighbours, ``LABELS`` for none; ``alike`` has the shares of labels
    among likenesses; ``counts`` the tokens of each label in the whole table.
    """
    drawn = np.bincount(labels, minlength=LABELS)
    rate = np.log(np.maximum(drawn, 1) / np.maximum(counts, 1))
    unseen = np.where(drawn == 0, -OBSERVED, 0.0)
    unary, sides, skip = np.zeros((FEATURES, LABELS)), np.zeros((2, LABELS + 1, LABELS)), np.zeros(LABELS)
    chain, n = np.zeros((LABELS + 1, LABELS + 1)), max(len(labels), 1)
    past = [np.full_like(p, 1e-8) for p in (unary, chain, skip)]
    flat = features.ravel()
    one = np.eye(LABELS)[labels]
    for _ in range(STEPS if len(labels) else 0):
        sides[0], sides[1] = chain[:, :LABELS], chain[:LABELS, :].T
        logits = unary[features].sum(axis=1) + sides[0][left] + sides[1][right] + alike * skip + rate + unseen
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        off = p / p.sum(axis=1, keepdims=True) - one
        spread = np.repeat(off, features.shape[1], axis=0)
        down = np.column_stack([np.bincount(flat, spread[:, k], FEATURES) for k in range(LABELS)])
        pairs = np.zeros_like(chain)
        np.add.at(pairs[:, :LABELS], left, off)
        np.add.at(pairs[:LABELS, :].T, right, off)
        pairs[LABELS] = pairs[:, LABELS] = 0  # a missing neighbour says nothing
        for p, slope, seen in zip((unary, chain, skip), (down / n, pairs / n, (off * alike).sum(axis=0) / n), past):
            slope = slope + DECAY * p
            seen += slope * slope
            p -= RATE * slope / np.sqrt(seen)
    return Model(unary + unseen / N_FEATURES, chain[:LABELS, :LABELS], skip)


SAMPLE_DDL = "place string, label int, features array<int>, around array<int>, alike array<double>, counted bigint"


def _drawn(per_label: int):
    """A task's part of the training sample: of each label the tokens with the smallest hashes, and its count."""

    def run(batches):
        held, counted = [], np.zeros(LABELS, np.int64)
        for texts in _texts(batches, 0):
            for text in texts:
                tokens = Tokens()
                tokens.add(text, base_spans(text))
                if not tokens.starts:
                    continue
                labels = np.array(tokens.labels)
                counted += np.bincount(labels, minlength=LABELS)
                chained = np.array(tokens.chained)
                left = np.where(chained, np.r_[LABELS, labels[:-1]], LABELS)
                right = np.where(np.r_[chained[1:], False], np.r_[labels[1:], LABELS], LABELS)
                alike = np.zeros((len(labels), LABELS))
                members = np.array(tokens.members, np.int64).reshape(-1, 2)
                totals = np.zeros((tokens.hubs, LABELS))
                np.add.at(totals, (members[:, 1], labels[members[:, 0]]), 1)
                others = totals[members[:, 1]] - np.eye(LABELS)[labels[members[:, 0]]]
                np.add.at(alike, members[:, 0], others / others.sum(axis=1, keepdims=True))
                digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                for i, label in enumerate(tokens.labels):
                    place = hashlib.blake2b(digest + tokens.starts[i].to_bytes(8, "big"), digest_size=8).hexdigest()
                    held.append((place, label, tokens.features[i], [int(left[i]), int(right[i])], alike[i].tolist()))
                if len(held) > 8 * LABELS * per_label:
                    held = _least(held, per_label)
        rows = [(*r, 0) for r in _least(held, per_label)]
        rows += [(None, k, None, None, None, int(c)) for k, c in enumerate(counted) if c]
        names = [c.split()[0] for c in SAMPLE_DDL.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int64()]
        yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=pa.schema(list(zip(names, kinds))))

    return run


def _least(held: list, per_label: int) -> list:
    kept, left = [], [per_label] * LABELS
    for row in sorted(held, key=lambda r: r[0]):
        if left[row[1]]:
            left[row[1]] -= 1
            kept.append(row)
    return kept


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[str]]:
    for batch in batches:
        values = batch.column(column)
        # sizes come from the offsets, so a batch of long texts turns into objects bit by bit
        for start, stop in in_bytes([v or 0 for v in pc.binary_length(values).to_pylist()], int, SLICE):
            yield [v or "" for v in values.slice(start, stop - start).to_pylist()]


def train(texts: DataFrame, per_label: int = PER_LABEL) -> Model:
    """The model of ``texts(text)``; at most ``per_label`` tokens of each label reach the driver."""
    sample = written(texts.select("text").mapInArrow(_drawn(per_label), SAMPLE_DDL), "tokens")
    counts = np.zeros(LABELS)
    for row in sample.groupBy("label").agg(F.sum("counted").alias("n")).collect():  # five rows
        counts[row.label] = row.n
    rank = F.row_number().over(Window.partitionBy("label").orderBy("place"))
    rows = sample.filter("place is not null").withColumn("nth", rank).filter(F.col("nth") <= per_label).drop("nth").collect()
    rows.sort(key=lambda r: (r.place, r.label))
    around = np.array([r.around for r in rows], int).reshape(-1, 2)
    return fit(
        np.array([r.label for r in rows], int), np.array([r.features for r in rows], int).reshape(-1, N_FEATURES),
        around[:, 0], around[:, 1], np.array([r.alike for r in rows]).reshape(-1, LABELS), counts,
    )


def added_spans(tokens: Tokens, beliefs: np.ndarray, first: int, last: int) -> list[tuple[int, int, int]]:
    """Runs of unobserved neighbouring tokens of a document that share a sure label."""
    spans, before = [], NONE
    for i in range(first, last):
        best = int(beliefs[i].argmax())
        label = best if tokens.labels[i] == NONE and beliefs[i][best] >= SURE else NONE
        if label != NONE and label == before and tokens.chained[i]:
            spans[-1] = (spans[-1][0], tokens.ends[i], label - 1)
        elif label != NONE:
            spans.append((tokens.starts[i], tokens.ends[i], label - 1))
        before = label
    return spans


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], s[2])))


def found_in(texts: list[str], model: Model) -> list[dict]:
    """Base and added spans of some texts, in one graph."""
    tokens = Tokens()
    bases = [base_spans(t) for t in texts]
    bounds = [tokens.add(t, b) for t, b in zip(texts, bases)]
    beliefs = model.beliefs(tokens) if tokens.starts else None
    return [{"base": base, "added": added_spans(tokens, beliefs, *part) if part[0] < part[1] else []} for base, part in zip(bases, bounds)]


OUT = [*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]


def personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document of ``docs(doc_id, text)``."""
    names = ["doc_id", *(n for n, _ in OUT)]

    def run(batches):
        for batch in batches:
            done = 0
            for texts in _texts([batch], 1):
                found = found_in(texts, model)
                columns = [batch.column(0).slice(done, len(texts))]
                for k in range(len(KINDS)):
                    columns.append(pa.array([sum(s[2] == k for s in f["base"]) for f in found], pa.int64()))
                columns.append(pa.array([hashlib.sha256(joined(f["base"]).encode()).hexdigest() for f in found]))
                columns.append(pa.array([joined(f["base"] + f["added"]) for f in found]))
                columns.append(pa.array([len(f["added"]) for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                done += len(texts)

    ddl = "doc_id bigint, " + ", ".join(f"{n} {'bigint' if t == pa.int64() else 'string'}" for n, t in OUT)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, ddl)


def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    return personal_data(docs, train(docs))
