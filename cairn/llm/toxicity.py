"""Toxicity by Levenshtein automata over a lexicon trie, with scores by context.

The lexicon is learned from labelled documents: words, and stems with open ends,
that occur almost only in toxic ones.  The Levenshtein automata of all terms,
intersected with their trie, are one machine whose states are sets of trie nodes with
the edits spent on the way to each.  A group of texts gives its distinct words in
order, so each of their prefixes takes one step of the machine whatever number of
words has it, and no more states are held than a word has letters.  Misspelled terms
are found so, any letter changed, left out or put in, the first included: every term
of three letters or more bears an edit, longer ones two (``Term.edits``).  A word near
a term that clean training texts use is an ordinary word, no misspelling.

How much a match of each kind tells is learned from the labelled documents, apart for
misspellings of words that tell by themselves and for all others.  A match between
paired quotation marks, or beside a word of reporting in its sentence, counts less
than a plain one; matches near one another or aimed at a person count more.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm.training import held_out, labelled

#: Training texts in which a term must occur, and the share of them that must be toxic; so there are no more terms than training words / SUPPORT.
SUPPORT, PRECISION = 8, 0.7
#: Letters of a stem, and of a word that is learned (a longer run of letters is no word).
STEM, STEM_MOST, WORD_MOST = 4, 12, 100
#: Clean training texts that make a word near a term an ordinary one.
ORDINARY = 2
#: Words on each side that make a match's context.
SPAN = 6
#: A term at or above this share tells by itself; a text with one other match may be clean.
STRONG = 0.97
QUOTE_FACTOR = 0.5
FEATURES = ("strong", "soft", "soft_share", "misspelled", "loose", "aimed", "clustered")
#: What the weights of FEATURES are believed to be before any row is seen, and how firmly.
BELIEF = (5.0, 1.5, 10.0, 3.5, 0.0, 0.5, 0.5)
FIRMNESS = 2.0
#: Words whose matches a task remembers, and texts whose words it looks up together.
REMEMBERED, TEXTS = 1 << 19, 256
THRESHOLD = 0.5

_WORD = re.compile(r"[^\W_]+(?:['’*@$!-]?[^\W_]+)*")
_MARK = re.compile("[\"“”«»„‟‹›\n]")
#: Marks that close what another one opens; straight ones, and those that either side may stand on, close their own kind.
_CLOSING = {'"': '"', "“": "”", "„": "“”", "‟": "”", "«": "»", "»": "«", "‹": "›", "›": "‹", "”": "”"}
_SENTENCE = re.compile(r"[.!?…\n]")
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes word words term terms dit disait mot sagte sagt wort dijo dice palabra".split())
PERSON = frozenset("you your you're ur du dich dein sie ihr tu te toi vous votre usted tú eres they he she".split())


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float

    @property
    def edits(self) -> int:
        """One from three letters on (stems, whose ends are open: from four), two from nine; shorter ones none, as every word of their length is near."""
        n = len(self.text)
        return (n >= 3 + self.stem) + (n >= 9)


class Automaton:
    """Words to (edits, term) of their best match, a word's prefixes shared with the words beside it."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.allowed = [0]
        for number, term in enumerate(terms):
            node = 0
            for c in term.text:
                self.allowed[node] = max(self.allowed[node], term.edits)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                node = self.children[node][c]
            self.allowed[node] = max(self.allowed[node], term.edits)
            self.ends[node].append(number)
        self.start = self._closed({0: 0})

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """Trie nodes with the fewest edits to each, with those that are reached by letters a word leaves out."""
        queue = list(nodes)
        while queue:
            n = queue.pop()
            e = nodes[n] + 1
            if e <= self.allowed[n]:
                for child in self.children[n].values():
                    if e <= self.allowed[child] and e < nodes.get(child, 9):
                        nodes[child] = e
                        queue.append(child)
        return nodes

    def _step(self, state: dict[int, int], c: str) -> dict[int, int]:
        nodes: dict[int, int] = {}
        allowed, children = self.allowed, self.children
        for n, e in state.items():
            own = children[n]
            if c in own and e < nodes.get(own[c], 9):
                nodes[own[c]] = e
            if e < allowed[n]:
                e += 1
                if e < nodes.get(n, 9):
                    nodes[n] = e
                for child in own.values():
                    if e <= allowed[child] and e < nodes.get(child, 9):
                        nodes[child] = e
        return self._closed(nodes)

    def _best(self, state: dict[int, int], stems: bool) -> tuple[int, int] | None:
        """The best term that ends in a state: any, or only stems."""
        found = [(e, t) for n, e in state.items() for t in self.ends[n] if e <= self.terms[t].edits and (not stems or self.terms[t].stem)]
        return min(found, default=None)

    def match_all(self, words) -> dict[str, tuple[int, int] | None]:
        """(edits, term) of the best match of each word: a whole term, or a stem that it begins with.

        Words are taken in order, and the states of the prefix that one shares with the
        next are kept for it.
        """
        out: dict[str, tuple[int, int] | None] = {}
        states = [(self.start, None)]  # of each prefix its state and the best stem so far
        last = ""
        for word in sorted(words):
            k = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                k += 1
            k = min(k, len(states) - 1)
            del states[k + 1 :]
            while k < len(word) and states[k][0]:
                state = self._step(states[k][0], word[k])
                here, stem = self._best(state, True), states[k][1]
                states.append((state, min((x for x in (here, stem) if x is not None), default=None)))
                k += 1
            state, stem = states[k]
            whole = self._best(state, False) if k == len(word) else None
            out[word] = min((x for x in (whole, stem) if x is not None), default=None)
            last = word
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        return self.match_all([word])[word]


def quoted_parts(text: str) -> list[tuple[int, int]]:
    """(start, end) between the quotation marks that belong together, in order; a mark without its partner in the line encloses nothing."""
    out, opened = [], []
    for m in _MARK.finditer(text):
        c = m.group()
        if c == "\n":
            opened.clear()
            continue
        for k in range(len(opened) - 1, -1, -1):
            if c in _CLOSING[opened[k][0]]:
                out.append((opened[k][1], m.start()))
                del opened[k:]
                break
        else:
            opened.append((c, m.end()))
    return sorted(out)


class Scorer:
    """Scores texts with a lexicon and the weights of FEATURES (the last weight is the constant); ``ordinary`` words are no misspellings."""

    def __init__(self, terms: list[Term], weights: list[float], ordinary: frozenset[str] = frozenset()):
        self.machine = Automaton(terms)
        self.weights = weights
        self.ordinary = dict.fromkeys(ordinary)
        self.known: dict[str, tuple[int, int] | None] = dict(self.ordinary)

    def look_up(self, texts: list[str]) -> None:
        """Match the words of some texts that are not known yet."""
        if len(self.known) > len(self.ordinary) + REMEMBERED:
            self.known = dict(self.ordinary)
        words = {w for t in texts for w in set(map(str.lower, _WORD.findall(t)))} - self.known.keys()
        self.known.update(self.machine.match_all(words))

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, edits, term) of every match, in order; ``look_up`` has seen the text."""
        known = self.known
        return [(m.start(), m.end(), *found) for m in _WORD.finditer(text) if (found := known[m.group().lower()]) is not None]

    def context(self, text: str, start: int, end: int, quoted: list[tuple[int, int]]) -> tuple[bool, bool]:
        """Whether a match is quoted (in paired marks, or beside a word of reporting in its sentence), and whether it is aimed at a person."""
        before, after = text[max(0, start - 12 * SPAN) : start], text[end : end + 12 * SPAN]
        left, right = _words_of(before)[-3:], _words_of(after)[:3]
        inside = any(a <= start and end <= b for a, b in quoted)
        own_left, own_right = _words_of(_SENTENCE.split(before)[-1])[-3:], _words_of(_SENTENCE.split(after)[0])[:2]
        return inside or bool(REPORTING & {*own_left, *own_right}), bool(PERSON & {*left, *right})

    def features(self, text: str) -> tuple[list[float], int, int, int]:
        """(FEATURES, exact matches, misspelled matches, quoted matches)."""
        strong = soft = wrong = loose = aimed_n = near = 0.0
        exact, quoted_n, last = 0, 0, None
        found = self.matches(text)
        marks = quoted_parts(text) if found else []
        for start, end, edits, t in found:
            quoted, aimed = self.context(text, start, end, marks)
            share = QUOTE_FACTOR if quoted else 1.0
            term = self.machine.terms[t]
            weight = term.weight
            if edits and weight >= STRONG and not (term.stem and len(term.text) < 6):
                wrong += share * weight
            elif edits:
                loose += share * weight
            elif weight >= STRONG:
                strong += share
            else:
                soft += share * weight
            aimed_n += aimed and not quoted
            near += last is not None and start - last < 8 * SPAN
            exact += not edits
            quoted_n += quoted
            last = end
        share = soft * 100 / max(20, len(text) / 6)
        log = math.log1p
        return [log(strong), log(soft), log(share), log(wrong), log(loose), log(aimed_n), log(near)], exact, len(found) - exact, quoted_n

    def each(self, texts: list[str | None], what):
        """``what`` of every text, the words of some texts looked up together."""
        for a in range(0, len(texts), TEXTS):
            part = [t or "" for t in texts[a : a + TEXTS]]
            self.look_up(part)
            yield from map(what, part)

    def scores(self, texts: list[str | None]) -> list[tuple[float, int, int, int]]:
        """(score, exact matches, misspelled matches, quoted matches) of each text."""
        return list(self.each(texts, self._score))

    def score(self, text: str | None) -> tuple[float, int, int, int]:
        return self.scores([text])[0]

    def _score(self, text: str) -> tuple[float, int, int, int]:
        x, *counts = self.features(text)
        z = sum(a * b for a, b in zip([*x, 1.0], self.weights, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), *counts


def _words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic weights, drawn to BELIEF where the rows say little."""
    x = np.hstack([x, np.ones((len(x), 1))])
    belief = np.array([*BELIEF, math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])
    firm = np.array([FIRMNESS] * len(BELIEF) + [1e-3])
    w = belief.copy()

    def loss(v: np.ndarray) -> float:
        z = np.clip(x @ v, -30, 30)
        return float((np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z).sum() + (firm * (v - belief) ** 2).sum() / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + firm * (w - belief)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(firm + 1e-6), slope)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-4:
            break
    w[:-1] = np.maximum(w[:-1], 0)  # no kind of match speaks for a text
    return w.tolist()


def learn(train: DataFrame) -> tuple[list[Term], list[float], frozenset[str]]:
    """(terms, weights of FEATURES, ordinary words) from (text, label).

    Word and stem counts are Spark aggregates; what comes to the driver are the terms,
    the ordinary words near them, both bounded by the TRAINING_ROWS texts, and the few
    features of each of these.
    """
    spark = train.sparkSession
    train = train.persist()
    whole = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t")).first()
    n, t = whole["n"] or 0, whole["t"] or 0
    if not t or t == n:
        train.unpersist()
        return [], [0.0] * len(FEATURES) + [math.log((t + 1) / (n - t + 1))], frozenset()
    # words as runs of letters, with everything between as one separator
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+"))
    counts = train.select("label", F.explode(words).alias("w")).where(F.length("w").between(STEM, WORD_MOST)).groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t"))
    counts = counts.persist()
    starts = F.explode(F.transform(F.sequence(F.lit(STEM), F.least(F.length("w"), F.lit(STEM_MOST))), lambda k: F.substring("w", 1, k))).alias("s")
    some = counts.where("t > 0 AND t >= n * 0.5").select(starts).distinct()
    stems = counts.select("n", "t", starts).groupBy("s").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("kinds")).join(some, "s", "left_semi")
    good = (F.col("t") >= SUPPORT) & (F.col("t") >= PRECISION * F.col("n"))
    exact = counts.where(good).select("w", "n", "t").collect()
    open_ = stems.where(good & (F.col("kinds") > 1)).collect()
    rate = t / n
    weigh = lambda v: (v[1] + rate) / (v[0] + 1)
    words_ = {r["w"]: (r["n"], r["t"]) for r in exact}
    strong = {w: v for w, v in words_.items() if weigh(v) >= STRONG}
    found = {}
    for r in open_:  # a stem must tell without the words that tell by themselves
        own = [v for w, v in strong.items() if w.startswith(r["s"]) and 2 * v[1] >= r["t"]]
        n_, t_ = r["n"] - sum(v[0] for v in own), r["t"] - sum(v[1] for v in own)
        if t_ >= SUPPORT and t_ >= PRECISION * n_:
            found[r["s"]] = (n_, t_)
    stem = {s: v for s, v in found.items() if not any(s[:k] in found for k in range(STEM, len(s)))}
    sure = {s for s, v in stem.items() if weigh(v) >= STRONG}
    plain = {w: v for w, v in words_.items() if not any(w[:k] in (sure if w in strong else stem) for k in range(STEM, len(w) + 1))}
    terms = [Term(w, False, weigh(v)) for w, v in sorted(plain.items())] + [Term(s, True, weigh(v)) for s, v in sorted(stem.items())]
    known = spark.sparkContext.broadcast(terms)

    def near(batches):
        machine = Automaton(known.value)
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = machine.match_all(words)
            yield batch.filter(pa.array([(found[w] or (0,))[0] > 0 for w in words], pa.bool_()))

    used = counts.where((F.col("n") - F.col("t") >= ORDINARY) & (F.col("t") < PRECISION * F.col("n"))).select("w")
    ordinary = frozenset(r["w"] for r in used.mapInArrow(near, "w string").collect())
    counts.unpersist()
    probe = spark.sparkContext.broadcast((terms, [*BELIEF, 0.0], ordinary))

    def look(batches):
        scorer = Scorer(*probe.value)
        for batch in batches:
            x = scorer.each(batch.column(0).to_pylist(), lambda t: scorer.features(t)[0])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    seen = train.mapInArrow(look, "label int, x array<double>").collect()
    train.unpersist()
    return terms, fit(np.array([r["x"] for r in seen]), np.array([r["label"] for r in seen], float)), ordinary


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted, n_exact, n_misspelled, n_quoted.

    ``labels`` has the ids as doc_id.  Null and empty texts get the score of a text
    without matches; without toxic training rows every text gets their smoothed
    share.  Repeated rows each come back, equal texts with equal scores; a null id is
    never held out.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(labelled(docs, labels, "toxic", id_col=id_col, text_col=text_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scorer = Scorer(*model.value)
        for batch in batches:
            got = scorer.scores(batch.column(2).to_pylist())
            columns = [pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= THRESHOLD) for g in got], pa.int32()), *[pa.array([g[k] for g in got], pa.int64()) for k in (1, 2, 3)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "score", "predicted", "n_exact", "n_misspelled", "n_quoted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_exact long, n_misspelled long, n_quoted long")
