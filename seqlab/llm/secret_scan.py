"""Secret scan by grammar inference (op 4).

Base spans come from three patterns (assign, access, hex).  Their values in a
bounded sample of documents are the labelled credentials: a prefix tree per
kind whose statistically compatible states are merged (Hoeffding bound on the
final and transition frequencies, red and blue states) gives a probabilistic
automaton of the kind's format.  An automaton of ordinary tokens is learned the
same way.  Every maximal run of ``[A-Za-z0-9+/_.=-]`` of at least ``min_chars``
characters in every text is scored by its log-likelihood ratio per character;
what scores above the threshold, found on held-out ordinary tokens, and meets
no base span is added as kind ``learned``.

A span is the whole match (for assign from the keyword to the value's end), in
code points, end exclusive.  Cases: a null text is empty; without labelled
credentials nothing is learned and only base spans come out.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE_DOCS = 10_000  # documents that training looks at, about
SAMPLE_VALUES = 400  # labelled values per kind
SAMPLE_TOKENS = 4_000  # ordinary tokens, half of them held out
MIN_CHARS = 16
KINDS = ("assign", "access", "hex", "learned")

#: Fixed patterns of the contract; keyword letters match in either case, ASCII only.
_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
                     for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_CHARS},}}")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, value), sorted."""
    out = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def tokens(text: str, base) -> list[tuple[int, int, str]]:
    """(start, end, token) of the candidate runs that meet no base span."""
    out = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    return [c for c in out if not any(s < c[1] and c[0] < e for s, _, e, _ in base)] if base else out


class Automaton:
    """A probabilistic deterministic automaton inferred from sample strings by state merging.

    Strings are read up to ``depth`` characters; ``alpha`` is the confidence of the
    compatibility test; ``symbols`` the size of the alphabet for smoothing.
    """

    def __init__(self, sample: list[str], alpha: float = 0.05, depth: int = 64, symbols: int = 68):
        self.alpha, self.symbols, self.depth = alpha, symbols, depth
        self.seen, self.ends, self.next = [0], [0], [{}]  # state -> strings through it, strings ending, char -> [state, count]
        for text in sample:
            self._add(text[:depth])
        self._merge_states()
        # Log-probabilities, smoothed; an unseen character leads back to the start.
        self.arcs, self.stop = [], []
        for q in range(len(self.seen)):
            whole = self.seen[q] + 0.5 * (self.symbols + 1)
            self.arcs.append({c: (t, math.log((n + 0.5) / whole)) for c, (t, n) in self.next[q].items()})
            self.stop.append((math.log((self.ends[q] + 0.5) / whole), math.log(0.5 / whole)))

    def _add(self, text):
        q = 0
        self.seen[0] += 1
        for c in text:
            if c not in self.next[q]:
                self.next[q][c] = [len(self.seen), 0]
                self.seen.append(0)
                self.ends.append(0)
                self.next.append({})
            arc = self.next[q][c]
            arc[1] += 1
            q = arc[0]
            self.seen[q] += 1
        self.ends[q] += 1

    def _differ(self, a, na, b, nb):
        if not na or not nb:
            return False
        return abs(a / na - b / nb) > math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def _compatible(self, a, b):
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.seen[a], self.seen[b]
            if self._differ(self.ends[a], na, self.ends[b], nb):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differ(x[1] if x else 0, na, y[1] if y else 0, nb):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, a, b):
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, (t, n) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][1] += n
                    todo.append((self.next[a][c][0], t))
                else:
                    self.next[a][c] = [t, n]

    def _merge_states(self):
        red = [0]
        while True:
            known = set(red)
            blue = [(-self.seen[t], t, q, c) for q in red for c, (t, _) in self.next[q].items() if t not in known]
            if not blue:
                return
            _, b, parent, c = min(blue)  # the most frequent first
            for r in red:
                if self._compatible(r, b):
                    self.next[parent][c][0] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)

    def score(self, text: str) -> float:
        """Log-likelihood of the whole text."""
        q, total = 0, 0.0
        for c in text:
            t, p = self.arcs[q].get(c, (0, self.stop[q][1]))
            total += p
            q = t
        return total + self.stop[q][0]


class Formats:
    """Automata of credential formats against one of ordinary tokens, and a threshold for each format.

    Ordinary tokens count in capitals too: capitals alone make no secret.  Half of them train their
    automaton, the other half sets the thresholds: none of it may be taken for a secret, by ``margin`` per character.
    """

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str], margin: float = 0.25):
        self.kinds = {k: Automaton(v) for k, v in sorted(labelled.items()) if v}
        train, held = ([y for t in part for y in (t, t.upper())] for part in (ordinary[::2], ordinary[1::2]))
        self.plain = Automaton(train)
        ratios = [self.ratios(t) for t in held]
        self.limits = {k: max([0.0, *(r[k] for r in ratios)]) + margin for k in self.kinds}

    def ratios(self, token: str) -> dict[str, float]:
        """Each format's log-likelihood ratio per character."""
        plain = self.plain.score(token)
        return {k: (a.score(token) - plain) / len(token) for k, a in self.kinds.items()}

    def is_secret(self, token: str) -> bool:
        return any(r > self.limits[k] for k, r in self.ratios(token).items())


def learn_formats(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, values: int = SAMPLE_VALUES, ordinary: int = SAMPLE_TOKENS) -> Formats:
    """Train on about ``sample_docs`` documents chosen by the hash of their id; the driver gets at most
    ``values`` values per kind and ``ordinary`` tokens, the first by hash."""
    share = max(1, min(1_000_000, round(1_000_000 * sample_docs / max(1, docs.count()))))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).select("text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for s in range(0, b.num_rows, 128):
                rows = set()
                for text in b.slice(s, 128).column(0).to_pylist():
                    base = base_spans(text or "")
                    rows |= {(KINDS[k], v) for _, k, _, v in base}
                    rows |= {("plain", t) for _, _, t in tokens(text or "", base)}
                rows = sorted(rows)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["kind", "value"])

    found = some.mapInArrow(run, "kind string, value string").distinct()
    most = F.when(F.col("kind") == "plain", ordinary).otherwise(values)
    # Top values by hash with bounded lists: each task keeps no more than it may send.
    best = found.select("kind", "value", F.xxhash64("value").alias("h")).repartition("kind", F.pmod("h", F.lit(64)))
    rank = F.row_number().over(Window.partitionBy("kind", F.pmod("h", F.lit(64))).orderBy("h", "value"))
    best = best.withColumn("r", rank).where(F.col("r") <= most).drop("r")
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("h", "value"))
    rows = best.withColumn("r", rank).where(F.col("r") <= most).orderBy("kind", "h", "value").collect()
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r.kind, []).append(r.value)
    return Formats({k: v for k, v in by.items() if k != "plain"}, by.get("plain", []))


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """(doc_id, spans: [kind, start, end]) for every row, sorted by start, then kind."""
    kept = docs.sparkSession.sparkContext.broadcast(formats)  # automata of bounded samples

    def run(batches):
        import pyarrow as pa

        known: dict[str, bool] = {}
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            for s in range(0, b.num_rows, 128):
                part, out = b.slice(s, 128), []
                for text in part.column(1).to_pylist():
                    base = base_spans(text or "")
                    spans = [(a, k, z) for a, k, z, _ in base]
                    for a, z, t in tokens(text or "", base):
                        hit = known.get(t)
                        if hit is None:
                            if len(known) > 200_000:
                                known.clear()
                            hit = known[t] = kept.value.is_secret(t)
                        if hit:
                            spans.append((a, 3, z))
                    out.append([{"kind": KINDS[k], "start": a, "end": z} for a, k, z in sorted(spans)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(item))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<kind:string,start:long,end:long>>")


def op4_secret_scan(docs: DataFrame) -> DataFrame:
    found = scan(docs, learn_formats(docs))
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("spans", lambda x: x["kind"] != "learned"), name), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", name), ",").alias("spans"))
