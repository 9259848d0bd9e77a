"""Personal data: base patterns, and a skip-chain conditional random field over what looks like it.

The field's nodes are the spans of a text that look like personal data: those of
the base patterns, with their labels given, and other runs of digits or mail-like
tokens, with labels to infer. A node's potential is a linear model of
its shape and context; neighbours share a transition potential;
nodes with the same or similar characters, however far apart, share a skip
potential. All are trained by pseudo-likelihood, and loopy message passing makes the
labels of a text consistent.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.llm.spans import Span, joined
from postlytics.llm.words import each_text, per_text
from postlytics.sources.staging import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
OTHER = len(KINDS)
#: Texts and nodes to learn from, chosen by hash.
SAMPLE_DOCS = 20_000
SAMPLE_NODES = 50_000
#: An inferred node is reported from this marginal on.
CERTAIN = 0.75
ROUNDS = 60
#: Neighbours are at most so many characters apart.
NEAR = 120
#: Steps of training, their size, and the weight of small weights.
STEPS, RATE, RIDGE = 250, 0.1, 0.1
_FEATURES = 1 << 14

# Fixed patterns. They match what the plain forms do, leftmost first, in time linear in the text:
# a number or name is only tried from its first character, as its later ones fail or succeed alike.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a node without a base label can look like.
_DIGITS = re.compile(r"\(?[0-9](?:[\x20().-]{0,3}[0-9]){6,}")
_MAIL = re.compile(r"(?:@|\(at\)|\[at\]|\x20at\x20)[A-Za-z0-9-]+(?:(?:\.|\(dot\)|\[dot\]|\x20dot\x20)[A-Za-z0-9-]+)+")


def luhn(digits: str) -> bool:
    total = 0
    for at, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if at % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append(Span("email", start, done))
            at = text.find("@", done)
        else:
            # What stands before a sign that fails cannot belong to a later address.
            done = at + 1
            at = text.find("@", done)
    return out


def base_spans(text: str | None) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test."""
    if not text:
        return []
    out = _emails(text)
    if not any(c in text for c in "0123456789"):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(Span("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(Span("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append(Span("phone", *m.span()))
    return out


@dataclass
class Node:
    start: int
    end: int
    label: int | None
    features: list[int]
    keys: list[str]


def _feature(name: str) -> int:
    """A fixed slot for a feature's name, the same in every process."""
    h = 2166136261
    for c in name.encode():
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return h % _FEATURES


def _shape(s: str) -> str:
    out: list[str] = []
    for c in s:
        k = "9" if c.isdigit() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)[:24]


def nodes_of(text: str, base: list[Span]) -> list[Node]:
    """Nodes of a text by start: base spans with labels, and what else looks like them without."""
    spans: list[tuple[int, int, int | None]] = [(s.start, s.end, KINDS.index(s.kind)) for s in base]
    starts, reach = [], []  # of the base spans, and how far they reach up to there
    for s in sorted(base, key=lambda s: s.start):
        starts.append(s.start)
        reach.append(max(s.end, reach[-1] if reach else 0))

    def free(start: int, end: int) -> bool:
        at = bisect_left(starts, end)
        return not at or reach[at - 1] <= start

    spans += [(*m.span(), None) for m in _DIGITS.finditer(text) if free(*m.span())]
    if "@" in text or "at" in text:
        done = 0
        for m in _MAIL.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            done = m.end()
            if start < m.start() and free(start, done):
                spans.append((start, done, None))
    return [node_of(start, text[start:end], label, text[max(0, start - 24) : start]) for start, end, label in sorted(spans, key=lambda s: (s[0], s[1]))]


def node_of(start: int, body: str, label: int | None, before: str) -> Node:
    """A node that reads ``body`` behind the characters ``before``."""
    digits = _digits(body)
    mail = bool(_MAIL.search(body))
    word = before.split()
    names = ["bias", f"sign {before[-1:]}", f"before {word[-1].lower()[-12:] if word else ''}"]
    if mail:
        sign = next(x for x in ("@", "(at)", "[at]", " at ") if x in body)
        dot = next((x for x in ("(dot)", "[dot]", " dot ") if x in body), ".")
        names += ["mail", f"mail {sign}", f"mail {sign} {dot}"]
    else:
        groups = re.findall("[0-9]+", body)
        names += [f"shape {_shape(body)}", f"digits {min(len(digits), 20)}", f"groups {[len(g) for g in groups][:8]}"]
        names += [f"parts {min(len(groups), 5)}", f"luhn {len(digits) > 12 and luhn(digits)}"]
    keys = _mail_keys(body) if mail else _number_keys(digits)
    return Node(start, start + len(body), label, [_feature(x) for x in names], keys)


def _mail_keys(body: str) -> list[str]:
    """All letters and digits of an address, and those of its name and of its domain."""
    name, _, domain = re.sub(r"\(at\)|\[at\]|\x20at\x20", "@", body.lower()).rpartition("@")
    domain = re.sub(r"\(dot\)|\[dot\]|\x20dot\x20", "", domain)
    name, domain = (re.sub(r"[^a-z0-9]", "", x) for x in (name, domain))
    return [f"{name}@{domain}", f"{name}@", f"@{domain}"]


def _number_keys(digits: str) -> list[str]:
    """The last seven digits, and these with any one of them left open."""
    last = digits[-7:]
    return [last, *(f"{last[:i]}*{last[i + 1 :]}" for i in range(len(last)))]


Edges = list[tuple[int, int]]


def edges_of(nodes: list[Node]) -> tuple[Edges, Edges, Edges]:
    """Neighbours; and each node with the nearest one before it with the same, and with each part of similar, characters.

    Numbers are the same if their last seven digits agree, and similar if six of these do; addresses are
    the same if their letters and digits agree, and similar if those of their names or domains do.
    """
    chain = [(i - 1, i) for i in range(1, len(nodes)) if nodes[i].start - nodes[i - 1].end <= NEAR]
    last: dict[str, int] = {}
    same, alike = [], []
    for i, node in enumerate(nodes):
        found = {last[key] for key in node.keys if key in last}
        twin = last.get(node.keys[0])
        if twin is not None:
            same.append((twin, i))
        alike += [(j, i) for j in sorted(found) if nodes[j].keys[0] != node.keys[0]]
        last.update((key, i) for key in node.keys)
    return chain, same, alike


@dataclass
class EntityField:
    """Log potentials: features by label, label by label for neighbours, agreement of same and of similar nodes."""

    unary: np.ndarray
    chain: np.ndarray
    same: float
    alike: float

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """Label marginals after loopy message passing, exact where the edges have no loop; given labels are certain."""
        k = OTHER + 1
        local = np.array([self.unary[n.features].sum(axis=0) for n in nodes])
        given = [i for i, n in enumerate(nodes) if n.label is not None]
        local[given] = -60.0
        local[given, [nodes[i].label for i in given]] = 0.0
        chain, same, alike = edges_of(nodes)
        pairs = [(a, b, self.chain) for a, b in chain]
        pairs += [(a, b, np.eye(k) * self.same) for a, b in same] + [(a, b, np.eye(k) * self.alike) for a, b in alike]
        if not pairs:
            return _softmax(local)
        source = np.array([x for a, b, _ in pairs for x in (a, b)])
        target = np.array([x for a, b, _ in pairs for x in (b, a)])
        bond = np.array([x for *_, p in pairs for x in (p, p.T)])
        message = np.zeros((len(source), k))
        back = np.arange(len(source)) ^ 1
        for _ in range(ROUNDS):
            belief = local.copy()
            np.add.at(belief, target, message)
            out = (belief[source] - message[back])[:, :, None] + bond
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            message, moved = 0.5 * (message + new), np.abs(new - message).max()
            if moved < 1e-6:
                break
        belief = local.copy()
        np.add.at(belief, target, message)
        return _softmax(belief)

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans, and those that the field adds."""
        base = base_spans(text)
        if not text:
            return base, []
        nodes = nodes_of(text, base)
        if all(n.label is not None for n in nodes):
            return base, []
        p = self.marginals(nodes)
        best = p[:, :OTHER].argmax(axis=1)
        sure = [i for i, n in enumerate(nodes) if n.label is None and p[i, best[i]] >= CERTAIN]
        return base, [Span(KINDS[best[i]], nodes[i].start, nodes[i].end) for i in sure]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def rewritten(kind: int, body: str) -> list[str]:
    """Other ways to write what a base pattern found, that no base pattern finds; none for kinds without such ways."""
    if KINDS[kind] == "email":
        name, _, domain = body.rpartition("@")
        return [f"{name} at {domain.replace('.', ' dot ')}", f"{name}(at){domain.replace('.', '(dot)')}", f"{name}[at]{domain.replace('.', '[dot]')}", f"{name}(at){domain}"]
    if KINDS[kind] == "phone":
        # The number without its country's code, with the signs it has and with others.
        local = re.sub(r"^\+[0-9]{1,3}[\x20.-]*(?=[(0-9])", "", body)
        groups = re.findall("[0-9]+", local)
        if len(groups) < 2:
            return []
        return [local, *(sign.join(groups) for sign in "-. "), f"({groups[0]}) {'-'.join(groups[1:])}"]
    if KINDS[kind] == "card":
        digits = _digits(body)
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [".".join(fours), " - ".join(fours)]
    return []


def plainly_other(body: str) -> bool:
    """True of what cannot be personal data as it stands: dates, decimals, runs of digits, lengths that no kind has, a word at a site."""
    if _MAIL.search(body):
        return " at " in body and " dot " not in body and "(dot)" not in body and "[dot]" not in body
    digits = _digits(body)
    if body.isdigit() or re.fullmatch(r"[0-9]+\.[0-9]+", body) or re.fullmatch(r"(?:19|20)[0-9]{2}([./-])[0-9]{2}\1[0-9]{2}|[0-9]{2}([./-])[0-9]{2}\2(?:19|20)[0-9]{2}", body):
        return True
    return not 7 <= len(digits) <= 19 or len(digits) == 8 or (len(digits) > 15 and not luhn(digits))


def _drawn(*of: object) -> int:
    """A fixed number for what is to be drawn."""
    return xxhash.xxh64_intdigest(repr(of).encode())


def lesson_of(text: str) -> list[tuple[Node, int | None]]:
    """Nodes of a text with what to learn about each; None for what stands as given.

    Some base spans are said again, or said instead, in other ways, some
    with a digit changed; each is learnt to be of its kind. Look-alikes that
    are plainly other are learnt as such, and so are numbers made of a span's
    digits in the ways of dates, decimals, thousands, ranges and running numbers. Other
    look-alikes are what the field is to decide, and are left out.
    """
    out: list[tuple[Node, int | None]] = []
    for node in nodes_of(text, base_spans(text)):
        body, before = text[node.start : node.end], text[max(0, node.start - 24) : node.start]
        if node.label is None:
            if plainly_other(body):
                out.append((node, OTHER))
            continue
        draw = _drawn(body, before, node.start)
        ways = rewritten(node.label, body)
        if not ways or draw % 4 == 0:
            out.append((node, None))
        else:
            # Digits alone say what they are only beside the same number written in full.
            ways += [_digits(ways[0])] if draw % 4 > 1 and KINDS[node.label] == "phone" else []
            said = ways[draw // 4 % len(ways)]
            if draw % 4 > 1:
                out.append((node, None))
            if draw % 4 == 3 and said[-1].isdigit():
                said = said[:-1] + str((int(said[-1]) + 1 + draw // 64 % 9) % 10)
            out.append((node_of(node.start, said, None, before), node.label))
        out += [(node_of(node.end + NEAR + 1, said, None, ""), OTHER) for said in _numbers(draw)[: 1 + draw // 8 % 2]]
    return out


def _numbers(draw: int) -> list[str]:
    """Numbers that say nothing of a person, in an order drawn."""
    d = str(draw % 10**18).rjust(18, "1")
    thousands = [d[0], d[1:4], d[4:7], d[7:10]][: 3 + draw % 2]
    day = f"{d[:2]}.{d[2:4]}.20{d[4:6]}"
    ways = [d[:7], d[:8], d[:10], d[:12], d[:13], " ".join(thousands), ".".join(thousands), f"{d[0]}.{d[1:9]}"]
    ways += [f"20{d[:2]}-{d[2]}{d[3]}-{d[4:6]}", day, f"{day} - {day}", f"{d[:4]}-{d[4:8]}", f"{d[:6]}-{d[6:8]}"]
    ways += [f"{d[:2]}.{d[2:5]}.{d[5]}.{d[6]}", f"97{d[0]}-{d[1]}-{d[2:4]}-{d[4:10]}-{d[10]}", f"a at {d[:3]}.com"]
    turn = draw // 4096 % len(ways)
    return ways[turn:] + ways[:turn]


def fit_field(docs: DataFrame, sample: int = SAMPLE_DOCS, nodes: int = SAMPLE_NODES) -> EntityField:
    """Train all potentials by pseudo-likelihood on the lessons of ``docs`` (text).

    About ``sample`` texts are learnt from, chosen by a hash, and about ``nodes`` different
    nodes of them; so many the driver gets, with their times. An empty table teaches nothing:
    its field adds no span.
    """
    texts = docs.filter("text IS NOT NULL").select("text")
    share = min(1.0, sample / max(1, texts.count()))

    def teach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["text"]:
                lesson = lesson_of(text)
                said = [n.label if y is None else y for n, y in lesson]
                chain, same, alike = edges_of([n for n, _ in lesson])
                near: list[list[int]] = [[] for _ in lesson]
                # What a neighbour's label adds to each label, numbered after the features.
                for shift, edges in ((0, chain), (2, same), (3, alike)):
                    for a, b in edges:
                        near[b].append(_FEATURES + shift * (OTHER + 1) + said[a])
                        near[a].append(_FEATURES + (1 if shift == 0 else shift) * (OTHER + 1) + said[b])
                for (node, y), around in zip(lesson, near, strict=True):
                    if y is not None:
                        seen[tuple(sorted(node.features + around)), y] += 1
            yield pd.DataFrame([(list(k), y, n) for (k, y), n in seen.items()], columns=["slots", "label", "n"])

    taught = texts.filter(_share("text", share)).mapInPandas(teach, "slots array<int>, label int, n long")
    taught = cut_lineage(taught.groupBy("slots", "label").agg(F.sum("n").alias("n")), "lessons")
    rows = taught.filter(_share("slots", min(1.0, nodes / max(1, taught.count())))).collect()
    rows.sort(key=lambda r: (r["slots"], r["label"]))
    return _trained([r["slots"] for r in rows], np.array([r["label"] for r in rows], dtype=int), np.array([r["n"] for r in rows], dtype=float))


def _share(column: str, share: float) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(column), 1) <= F.lit(min(int(share * 2**63), 2**63 - 1))


def _trained(slots: list[list[int]], labels: np.ndarray, times: np.ndarray) -> EntityField:
    """Weights of greatest pseudo-likelihood, less a penalty on large ones, by gradient steps of adapted size."""
    k = OTHER + 1
    if not slots:
        none = np.zeros((_FEATURES, k))
        none[_feature("bias"), OTHER] = 10.0
        return EntityField(none, np.zeros((k, k)), 0.0, 0.0)
    row = np.repeat(np.arange(len(slots)), [len(x) for x in slots])
    slot = np.concatenate([np.array(x) for x in slots])
    unary, chain, agree = np.zeros((_FEATURES, k)), np.zeros((k, k)), np.zeros(2)
    parts = [unary, chain, agree]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    size = _FEATURES + 4 * k
    for step in range(1, STEPS + 1):
        # One table of what each slot adds to each label; the bonds are shared by both ends.
        table = np.concatenate([unary, chain, chain.T, np.eye(k) * agree[0], np.eye(k) * agree[1]])
        score = np.zeros((len(slots), k))
        np.add.at(score, row, table[slot])
        off = _softmax(score)
        off[np.arange(len(labels)), labels] -= 1.0
        off *= times[:, None]
        down = np.zeros((size, k))
        np.add.at(down, slot, off[row])
        left, right, same, alike = (down[_FEATURES + i * k :][:k] for i in range(4))
        slopes = [down[:_FEATURES], left + right.T, np.array([np.trace(same), np.trace(alike)])]
        for at, (part, slope) in enumerate(zip(parts, slopes, strict=True)):
            slope = (slope + RIDGE * part) / times.sum()
            first[at] = 0.9 * first[at] + 0.1 * slope
            second[at] = 0.999 * second[at] + 0.001 * slope**2
            part -= RATE * (first[at] / (1 - 0.9**step)) / (np.sqrt(second[at] / (1 - 0.999**step)) + 1e-12)
    return EntityField(unary, chain, float(agree[0]), float(agree[1]))


def find_pii(docs: DataFrame, field: EntityField) -> DataFrame:
    """(doc_id, n_ per kind, base, spans) for each row of ``docs`` (doc_id, text).

    Counts and ``base`` are of the base patterns, ``spans`` are these and what the
    field adds, both as kind:start:end, comma-joined. Offsets are code points, ends exclusive. NULL and empty texts have no
    spans; texts are read whole, in time linear in their length; repeated rows
    get equal answers, an empty table none; further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    counted = KINDS

    def find(text: str | None) -> tuple:
        base, added = shared.value.spans(text)
        numbers = [sum(s.kind == kind for s in base) for kind in counted]
        return (*numbers, joined(base, KINDS), joined([*base, *added], KINDS))

    columns = {f"n_{kind}": pa.int64() for kind in counted} | {"base": pa.string(), "spans": pa.string()}
    return per_text(docs, columns, find)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """``text`` with each span, or each group of overlapping spans, as its kind in brackets."""
    if not text or not spans:
        return text
    out, done, at = [], 0, 0
    ordered = sorted(spans, key=lambda s: (s.start, -s.end))
    while at < len(ordered):
        kind, start, end = ordered[at]
        at += 1
        while at < len(ordered) and ordered[at].start < end:
            end = max(end, ordered[at].end)
            at += 1
        out += [text[done:start], f"<{kind}>"]
        done = end
    return "".join([*out, text[done:]])


def redact_documents(docs: DataFrame, field: EntityField) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and all other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def redacted(text: str | None) -> str | None:
        return None if text is None else redact(text, [s for part in shared.value.spans(text) for s in part])

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return each_text(texts, redacted, pa.string())

    return docs.withColumn("text", clean("text"))
