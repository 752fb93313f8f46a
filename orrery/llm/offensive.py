"""Scores texts for abusive, hateful or sexual content.

Text is restored by a noisy channel before it is judged: a character lattice of what each written character may stand for
(look-alikes, digits for letters, masks, spacing, repetition) is decoded by Viterbi search, jointly with the places where
words end, under a character language model counted over the whole corpus. A reading is taken if it is likelier than that
the token is no word at all. Restored text is cut into passages; a logistic model over their words, pairs, triples, traces
of disguise and lexicon classes judges each, and a document has the score of its worst passage. The weights are learned
from the reviews.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Reviewed documents, unreviewed ones, and distinct passages of theirs that the model is fitted on at most, by hash.
TRAIN_DOCS, UNREVIEWED_DOCS, TRAIN_PASSAGES = 20_000, 10_000, 300_000
#: Cells of the language model's table of character n-grams and of the model's weights, as powers of two.
GRAM_BITS, BITS = 18, 18
THRESHOLD = 0.25
PASSAGE_WORDS = 40
#: Log-odds below which the worst passage of a document called offensive is taken for a slip of the reviewer.
DOUBT = -1.0
#: Mean log-odds of a passage's features, offensive documents to fine ones, from which it counts as what was meant.
TELLING = 1.25
#: Times that a passage is met in unreviewed documents from which it is taken for a fine one.
COMMON = 20
#: Weight of a passage that one reviewer alone stands for.
SINGLE = 0.6
#: Passages that a feature is taken to have been met in before any is read, so that few say little.
PRIOR_COUNT = 3.0
#: Log-probability of a character of a token that is no word, and what it takes to believe in a disguise at all.
NO_WORD, DISGUISE = -2.6, -1.0
#: Tokens that one worker remembers before it starts afresh.
MEMO = 500_000

# What a written character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "&": "a"}
MASKS = "*#"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LOOKALIKES = str.maketrans("абвгезіїјклмнорсԁѕтухһԛԝүαβεικνορτυχ", "abbre3iijklmhopcdstyxhqwyabeikvoptux")

# A lexicon in the languages of the corpus; a closing * stands for any ending. Its classes are features with
# learned weights, and its words are known to the language model.
WORDS = {
    "insult": "idiot* moron* imbecile* cretin* halfwit* dimwit* nitwit* dumbass* dumbfuck* scumbag* scum asshole* arsehole* jackass* bastard* bitch* cunt* twat* wanker* prick douchebag* dickhead* retard* fuckwit* shithead* motherfucker* loser* lowlife* whore* slut* vermin subhuman* degenerate* simpleton* crybaby arschloch arschlöcher vollidiot* trottel vollpfosten abschaum missgeburt hurensohn* fotze* schlampe* wichser* drecksau miststück penner spast* dummkopf pisser idiota* imbécil* imbecil* gilipollas cabrón cabron* puta putas puto hijoputa pendejo* maricón zorra* capullo* subnormal* tarado* malparido connard* connasse* abruti* crétin* imbécile* enculé* salope* salaud* pute putain* bâtard* ordure* débile* bouffon* raclure* minable* merdeux",
    "weak_insult": "shit* miserable crap pig pigs rat rats ape apes worm worms slug parasite* dog dogs swine cow cockroach* beast* animal* monkey* oxygen dirt garbage trash rubbish clown* dummy fool* liar* thief thieves cheat* dreck sau schwein* affe ungeziefer fresse basura rata ratas cerdo* cerda* asco mierda escoria alimaña* gueule vermine merde porc rats chien chiens",
    "adjective": "miserable pathetic worthless stinking filthy ugly brainless stupid dumb dirty disgusting useless fat lazy thick fucking fuckin bloody goddamn absolute complete total dumm dummer dumme geile geiler dreckig* hässlich* estúpid* asqueros* inútil* sale pauvre stupide dégueulasse*",
    "sex": "fuck fucks fucked fucker* cock cocks cum cumming tits titties boobs nipple* panties pussy dick dicks blowjob* handjob* horny orgasm* masturbat* porn* nude nudes erotic* dildo* anal orgy slutty milf hentai ficken fick fickt gefickt titten muschi schwanz nackt geil geile blasen wichsen follar* follarte polla coño tetas chupar* chúpame desnuda desnudas corrida cachonda* baiser baise niquer nique bite couilles seins chatte nue nues suce sucer bander",
    "weak_sex": "naked lick* licked moan* spank* strip stripped spread threesome* explicit skin bra blouse lips wet hard bed kiss* sweet sexy hot girls wife jerk bend scream come hips legs undress clips zieh ausziehen culo cama labios mouillée",
    "violence": "kill killed kills murder* shoot shot stab* hang hanged drown* choke* strangle* burn burned rape* raped beat smash* break slap* slapped spit die dies dead death hurt bleed suicide bullet noose knife kys lynch* sterben stirb verrecke* umbringen erschieß* aufhängen schlag* mueras muere muérete matar* matarte colgar* ahorcar* crève crever crevez tuer pends suicide meurs",
    "group": "immigrant* migrant* foreigner* refugee* jews jew muslim* christian* believer* atheist* blacks whites gays gay lesbian* trans cripple* disabled women woman men old people folk race natives gypsies asylum ausländer flüchtling* juden muslime frauen behinderte zigeuner* inmigrante* extranjero* mujeres judíos moros gitanos étranger* immigré* femmes juifs arabes musulmans handicapés",
    "hate": "vermin rats animals subhuman thieves stink stinks breed filthy lazy cleanse cleansed deport* exterminat* burned box vanish* boat sink ruin place cheats disease plague inferior dreck verschwinden ungeziefer raus abschieben vergasen ratas echarlos fuera plaga vermine dehors racaille expulser",
    "person": "you your yours yourself u ur op asker author user whoever he she they guy dude him her du dich dir dein deine deiner ihr euch tu te ti tus eres usted ustedes vosotros toi ton ta tes vous votre",
    "self": "i me my myself sorry ich mein meine mir perdón mi soy je mon ma désolé",
}
FLAGS = list(WORDS)
PAIRS = [(a, b) for i, a in enumerate(FLAGS) for b in FLAGS[i + 1 :]]
#: Where the fit starts, and stays where no review says anything: the lexicon's strong classes and their meeting a person.
START = {"insult": 2.2, "sex": 3.0, "insult+person": 1.8, "insult+self": -1.0, "adjective+insult": 1.5, "group+hate": 2.6, "person+violence": 0.9}
BIAS = -3.0
NAMED = {n: i for i, n in enumerate([*FLAGS, *("+".join(sorted(p)) for p in PAIRS)])}
#: Hashed words, pairs and triples; then lexicon classes and their pairs; then the bias.
WIDTH = (1 << BITS) + len(NAMED) + 1
#: Stands before a restored word, as a word of its own: that something was disguised says something too.
TRACE = "\u2402"


def _lists() -> tuple[dict[str, int], dict[str, list[tuple[str, int]]]]:
    exact: dict[str, int] = defaultdict(int)
    stems: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for i, words in enumerate(WORDS.values()):
        for w in words.split():
            exact[w.rstrip("*")] |= 1 << i
            if w.endswith("*"):
                stems[w[:3]].append((w[:-1], 1 << i))
    return dict(exact), dict(stems)


EXACT, STEMS = _lists()


def kinds_of(word: str) -> int:
    """Lexicon classes that a word is in, as bits."""
    bits = EXACT.get(word, 0)
    for stem, bit in STEMS.get(word[:3], ()):
        if word.startswith(stem):
            bits |= bit
    return bits


def cell(gram: str) -> int:
    return zlib.crc32(gram.encode()) & ((1 << GRAM_BITS) - 1)


def gram_table(weights: dict[str, float]) -> np.ndarray:
    """Weighted counts of the character n-grams (1 to 4) of words, in a hashed table; 0 ends the count of a context."""
    table = np.zeros(1 << GRAM_BITS)
    for w, c in weights.items():
        text = f"^^^{w}$"
        for i in range(3, len(text)):
            for n in (1, 2, 3, 4):
                table[cell(text[i - n + 1 : i + 1])] += c
                table[cell(text[i - n + 1 : i] + "\0")] += c
    return table


class LanguageModel:
    """Interpolated character model of order 4 over the words of a corpus and of the lexicon, of fixed size."""

    def __init__(self, counts: dict[str, int], table: np.ndarray | None = None):
        own = {w: math.log1p(c) for w, c in counts.items()} | {"a": 8.0, "i": 8.0}
        lexicon = {w: 3.0 for w in EXACT if w not in own}
        known = gram_table(own | lexicon)
        self.table = (known if table is None else known + table).tolist()
        self.total = self.table[cell("\0")]
        self.cache: dict[tuple[str, str], float] = {}

    def logp(self, past: str, c: str) -> float:
        key = (past, c)
        if (known := self.cache.get(key)) is None:
            p = 0.02 * (self.table[cell(c)] + 0.1) / (self.total + 10)
            for n, weight in ((1, 0.08), (2, 0.25), (3, 0.65)):
                seen = self.table[cell(past[-n:] + "\0")]
                if seen:
                    p += weight * self.table[cell(past[-n:] + c)] / seen
            if len(self.cache) > 4 * MEMO:
                self.cache.clear()
            known = self.cache[key] = math.log(min(p, 1.0))
        return known


Edge = tuple[str, float]


def lattice(token: str) -> list[list[Edge]]:
    """Per position the strings it may stand for with their channel cost; '' where it may stand for nothing."""
    out: list[list[Edge]] = []
    i = 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        if c.isalpha() and j - i >= 3:
            out.append([(c, -0.5), (c * 2, -0.7)])
            i = j
            continue
        if c in MASKS:
            out.append([(x, -0.3) for x in LETTERS])
        elif c in LEET:
            out.append([(x, -0.3) for x in LEET[c]] + ([("", -2.5)] if not c.isdigit() else []))
        elif c.isalpha():
            out.append([(c, 0.0)])
        else:
            out.append([("", -0.2)])
        i += 1
    return out


def viterbi(token: str, lm: LanguageModel, words: bool = False) -> list[tuple[float, str]]:
    """Readings of a token, best first: the best path per state, and all states are kept.

    A state is the last three characters. With `words`, a reading may hold several words, parted by blanks: after each
    character a word may end and the next begin.
    """
    states: dict[str, tuple[float, tuple]] = {"^^^": (0.0, ())}
    for at, edges in enumerate(lattice(token)):
        after: dict[str, tuple[float, tuple]] = {}
        for past, (score, path) in states.items():
            starts = [(past, score, path)]
            if words and at and past[-1] != "^":
                starts.append(("^^^", score + lm.logp(past, "$"), (path, " ")))
            for begin, begun, way in starts:
                for piece, cost in edges:
                    s, p = begun + cost, begin
                    for c in piece:
                        s += lm.logp(p, c)
                        p = (p + c)[-3:]
                    if p not in after or after[p][0] < s:
                        after[p] = (s, (way, piece) if piece else way)
        states = after

    def text(path: tuple) -> str:
        parts = []
        while path:
            path, piece = path
            parts.append(piece)
        return "".join(reversed(parts))

    return sorted(((s + lm.logp(p, "$"), text(path)) for p, (s, path) in states.items()), reverse=True)


#: A token longer than this is decoded in windows that overlap by half; the readings that are accepted stand for it.
WINDOW = 64
LET = r"0-9a-zß-öø-ÿ@$!*|€"
SPACED = re.compile(rf"(?<![{LET}])[{LET}]([ .\-_·]{{1,3}})[{LET}](?:\1[{LET}])+(?![{LET}])")
TOKEN = re.compile(r"[^\s\"'`<>{}\[\],;:/\\=_]+")
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
ODD = re.compile(r"[0-9@$!|+*#€£¡&]|(\w)\1\1")
MASKED = re.compile(r"[*#]{3,}")
URL = re.compile(r"https?://\S+|\S+\.(example|invalid)\S*")
FOREIGN = re.compile("[\u0370-\u052f]")
WORD = re.compile(rf"[^\W\d_]+|\d+|{TRACE}")


def decode(core: str, lm: LanguageModel, words: bool = False) -> str:
    """The likeliest reading of a token, or the token where none is likelier than that it is no word."""
    if len(core) > WINDOW:
        half = WINDOW // 2
        parts = [core[i : i + half] for i in range(0, len(core), half)]
        read = [decode(a + b, lm, words) for a, b in zip(parts, parts[1:])]
        hits = [r for r, a, b in zip(read, parts, parts[1:]) if r != a + b]
        return " ".join(hits) if hits else core
    score, reading = viterbi(core, lm, words)[0]
    return reading if score > NO_WORD * len(core) + DISGUISE else core


def plain(text: str) -> str:
    """Lower case, without invisible characters; look-alike letters of other scripts in Latin words replaced."""
    if text.isascii():
        return text.lower()
    text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower()
    if FOREIGN.search(text):
        text = "".join(w.translate(LOOKALIKES) if FOREIGN.search(w) and re.search("[a-z]", w) else w for w in re.split(r"(\W+)", text))
    return text


class Restorer:
    """Undoes disguises; remembers distinct tokens, so that each is decoded once."""

    def __init__(self, lm: LanguageModel, memo: dict[str, str] | None = None):
        self.lm, self.memo = lm, {} if memo is None else memo

    def piece(self, piece: str) -> str:
        """A token without white space, quotes or brackets."""
        core = piece.strip(".?!,)(-")
        letters = sum(c.isalpha() for c in core)
        if len(core) < 3 or not ODD.search(core) and core.isalpha() or letters * 3 < len(core) - core.count("*") or not letters:
            return piece
        if MASKED.search(core) or sum(c in MASKS for c in core) > letters:
            return piece  # too little is left to decode; f*** is a word of its own to the model
        read = decode(core, self.lm)
        return piece if read == core else piece.replace(core, TRACE + " " + read)

    def token(self, token: str) -> str:
        if (known := self.memo.get(token)) is None:
            known = TOKEN.sub(lambda m: self.piece(m.group(0)) if ODD.search(m.group(0)) or "." in m.group(0) or "-" in m.group(0) or "·" in m.group(0) else m.group(0), token)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[token] = known
        return known

    def joined(self, m: re.Match) -> str:
        """Letters written apart, with words and disguises read jointly."""
        run = m.group(0).replace(m.group(1), "")
        letters = sum(c.isalpha() for c in run)
        if len(run) < 3 or letters * 3 < len(run):
            return m.group(0)
        read = viterbi(run, self.lm, words=True)[0][1] if len(run) > 5 else run if run.isalpha() else decode(run, self.lm)
        return f"{TRACE} {read}"

    def apart(self, text: str) -> str:
        """Look-alikes, addresses and spacing of a whole text."""
        text = plain(text)
        if "://" in text or ".example" in text or ".invalid" in text:
            text = URL.sub(" url ", text)
        return SPACED.sub(self.joined, text)


def restore(text: str, lm: LanguageModel, memo: dict[str, str]) -> str:
    """Lower-case text with look-alikes, spacing, masks, digits for letters and repetition undone."""
    r = Restorer(lm, memo)
    text = re.sub(r"\S+", lambda m: r.token(m.group(0)), r.apart(text))
    return text.replace(TRACE + " ", "").replace("_", " ")


STOP = re.compile(r"[.!?;]\s+")
TAG = re.compile(r"</?\w+>")


def parts_of(text: str) -> list[str]:
    """Sentences and lines, code fences, tags, comment signs and printed strings parted from what is around them."""
    for sign in ("\r", "\n", "```", "--", "//", "print("):
        if sign in text:
            text = text.replace(sign, ". ")
    return STOP.split(TAG.sub(". ", text) if "<" in text else text)


def windows(words: list) -> Iterator[list]:
    """Words of a sentence or line; of a very long one overlapping windows, so that nothing is cut off."""
    for at in range(0, max(1, len(words) - PASSAGE_WORDS // 2), PASSAGE_WORDS // 2):
        yield words[at : at + PASSAGE_WORDS]


def passages(restored: str) -> list[list[str]]:
    """Words of each sentence or line of a restored text, numbers as 9; passages of numbers only are left out."""
    out = []
    for part in parts_of(restored):
        words = ["9" if w[0].isdigit() else w for w in WORD.findall(part)]
        out += [w for w in windows(words) if any(x != "9" for x in w)]
    return out


#: A word as one integer: its hash above, its lexicon classes in the low bits. Numbers are all the same word.
KIND_BITS = len(FLAGS)
NUMBER = zlib.crc32(b"9") << KIND_BITS


def code_of(word: str) -> int:
    return NUMBER if word[0].isdigit() else (zlib.crc32(word.encode()) << KIND_BITS) | kinds_of(word)


class Reader:
    """Texts to coded passages. Each distinct token is restored, split and coded once."""

    def __init__(self, lm: LanguageModel):
        self.restorer = Restorer(lm)
        self.codes: dict[str, tuple[int, ...]] = {}

    def coded(self, token: str) -> tuple[int, ...]:
        if (known := self.codes.get(token)) is None:
            if len(self.codes) >= MEMO:
                self.codes.clear()
            text = token if token.isalpha() else self.restorer.token(token)
            known = self.codes[token] = tuple(code_of(w) for w in WORD.findall(text))
        return known

    def passages(self, text: str) -> Iterator[list[int]]:
        known, coded = self.codes.get, self.coded
        for part in parts_of(self.restorer.apart(text)):
            words: list[int] = []
            for t in part.split():
                code = known(t)
                words += coded(t) if code is None else code
            if len(words) <= PASSAGE_WORDS:
                if words:
                    yield words
            else:
                yield from windows(words)


def features(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, passage, value) of all features of passages that lie in `words` one after the other from `starts`."""
    n = len(words)
    size = np.diff(np.r_[starts, n])
    row = np.repeat(np.arange(len(starts)), size)
    h = (words >> KIND_BITS).astype(np.uint64)
    one = h * np.uint64(2654435761)
    in2, in3 = row[1:] == row[:-1], row[2:] == row[:-2]
    two = ((h[:-1] * np.uint64(31) + h[1:]) * np.uint64(2246822519))[in2]
    three = (((h[:-2] * np.uint64(31) + h[1:-1]) * np.uint64(37) + h[2:]) * np.uint64(3266489917))[in3]
    col = ((np.concatenate([one, two, three]) >> np.uint64(7)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    rows = np.concatenate([row, row[1:][in2], row[2:][in3]])
    count = np.bincount(rows, minlength=len(starts))
    value = (2 / np.sqrt(np.maximum(count, 1)))[rows]  # long passages do not outweigh short ones
    kinds = np.bitwise_or.reduceat(words & ((1 << KIND_BITS) - 1), starts) if len(starts) else np.zeros(0, np.int64)
    has = (kinds[:, None] >> np.arange(KIND_BITS)) & 1 == 1
    named = [(NAMED[f], has[:, i]) for i, f in enumerate(FLAGS)] + [(NAMED["+".join(sorted(p))], has[:, FLAGS.index(p[0])] & has[:, FLAGS.index(p[1])]) for p in PAIRS]
    hit = [np.flatnonzero(f) for _, f in named]
    col = np.concatenate([col, *(np.full(len(r), (1 << BITS) + i) for (i, _), r in zip(named, hit))])
    return col, np.concatenate([rows, *hit]), np.concatenate([value, np.ones(sum(map(len, hit)))])


def start_weights() -> np.ndarray:
    w = np.zeros(WIDTH)
    w[-1] = BIAS
    for name, v in START.items():
        w[(1 << BITS) + NAMED[name]] = v
    return w


def judge(words: np.ndarray, starts: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores, 0..1, of passages; one of numbers only has 0."""
    col, row, value = features(words, starts)
    s = np.bincount(row, weights=w[col] * value, minlength=len(starts)) + w[-1]
    worded = np.bincount(np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(words)])), weights=words != NUMBER, minlength=len(starts)) > 0
    return np.where(worded, 1 / (1 + np.exp(-np.clip(s, -30, 30))), 0.0)


def fit(words: np.ndarray, starts: np.ndarray, doc: np.ndarray, label: np.ndarray, sure: np.ndarray, weight: np.ndarray, lexicon: bool = True, rounds: int = 6, steps: int = 60, l2: float = 0.02) -> np.ndarray:
    """Weights from labelled passages by multiple-instance learning; doc names their document.

    label is 1 for offensive documents, 0 for fine ones, -1 for unreviewed ones. All passages of fine documents are fine.
    Of an offensive document those are offensive whose features are met there far oftener than in fine and unreviewed
    documents, those that the model of the round before holds for likely, and its worst one unless the model doubts that
    (reviewers slip). Common passages of unreviewed documents are taken for fine ones. `weight` counts how often a passage occurs, `sure` says that more than one reviewer called its document
    offensive. Weights are drawn to the start, which without `lexicon` is 0 for all lexicon classes.
    """
    start = start_weights()
    if not lexicon:
        start[1 << BITS : -1] = 0
    w = start.copy()
    if not len(starts):
        return w
    col, row, value = features(words, starts)
    if not lexicon:
        keep = col < 1 << BITS
        col, row, value = col[keep], row[keep], value[keep]
    used, at = np.unique(col, return_inverse=True)
    n, offensive = len(starts), label == 1
    # How much oftener a feature is met in passages of offensive documents than in those of fine ones.
    n_met, n_fine = (weight * offensive).sum() + 1, (weight * ~offensive).sum() + 1
    met = np.bincount(at, weights=offensive[row] * weight[row], minlength=len(used))
    fine = np.bincount(at, weights=(~offensive)[row] * weight[row], minlength=len(used))
    share = n_met / (n_met + n_fine)
    met -= 0.7 * np.sqrt(met)  # the low end of what chance may have made of it
    odds = np.clip(np.log(met / share + PRIOR_COUNT) - np.log(fine / (1 - share) + PRIOR_COUNT), -3, 3)
    telling = np.bincount(row, weights=odds[at], minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)

    counts = (label >= 0) | (offensive.any() & (weight >= COMMON))
    keep, place = counts[row], np.cumsum(counts) - 1
    row, value, at = place[row[keep]], value[keep], at[keep]
    label, offensive, sure, weight, telling, doc, n = label[counts], offensive[counts], sure[counts], weight[counts], telling[counts], doc[counts], int(counts.sum())
    if not n:
        return w

    def scores(v: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(row, weights=v[at] * value, minlength=n) + bias

    _, group = np.unique(doc, return_inverse=True)
    s = scores(start[used], start[-1]) + telling
    for _ in range(rounds):
        worst = np.full(group.max() + 1, -np.inf)
        np.maximum.at(worst, group, s)
        y = (offensive & ((s > 0.5) | (telling > np.where(sure, TELLING / 2, TELLING)) | ((s >= worst[group] - 1e-9) & (s > DOUBT)))).astype(float)
        each = np.where(offensive & (y == 0), 0.3, np.where(offensive & ~sure, SINGLE, 1.0)) * np.minimum(weight, 3.0)
        each = np.where(label < 0, 10.0, each)
        v, bias = w[used].copy(), w[-1]
        g2, gb2 = np.full(len(used), 1e-3), 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(scores(v, bias), -30, 30)))
            err = (p - y) * each
            g = np.bincount(at, weights=err[row] * value, minlength=len(used)) + l2 * (v - start[used])
            gb = err.sum()
            g2 += g * g
            gb2 += gb * gb
            v -= 0.5 * g / np.sqrt(g2)
            bias -= 0.1 * gb / math.sqrt(gb2)
        w = start.copy()
        w[used], w[-1] = v, bias
        s = scores(v, bias)
    return w


def gram_weights(documents: DataFrame) -> np.ndarray:
    """The table of character n-grams of all words of all documents, each distinct word by the logarithm of its count."""
    words = documents.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter(F.length("w") > 1)
    words = words.groupBy("w").agg(F.log1p(F.count("*").cast("double")).alias("c"))
    marked = words.select(F.concat(F.lit("^^^"), "w", F.lit("$")).alias("t"), "c")
    cut = lambda n, end: F.transform(F.sequence(F.lit(4), F.length("t")), lambda i: F.concat(F.col("t").substr(i - n + 1, F.lit(n)), F.lit("")) if end else F.concat(F.col("t").substr(i - n + 1, F.lit(n - 1)), F.lit("\0")))
    grams = marked.select("c", F.explode(F.concat(*[cut(n, e) for n in (1, 2, 3, 4) for e in (True, False)])).alias("g"))
    cells = grams.groupBy(F.crc32(F.col("g").cast("binary")).bitwiseAND(F.lit((1 << GRAM_BITS) - 1)).alias("cell")).agg(F.sum("c").alias("c"))
    table = np.zeros(1 << GRAM_BITS)
    got = cells.toPandas()  # at most a row per cell of the table
    table[got["cell"].to_numpy(np.int64)] = got["c"].to_numpy(float)
    return table


def reviewed(documents: DataFrame, reviews: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, text, y, sure: documents on which most reviewers that took sides agree, sure by two votes or more.

    A bounded sample by hash of doc_id.
    """
    side = F.when(F.col("verdict") == "offensive", 1).when(F.col("verdict") == "fine", -1).otherwise(0)
    votes = reviews.dropDuplicates(["doc_id", "reviewer", "verdict"]).groupBy("doc_id").agg(F.sum(side).alias("s")).filter("s <> 0")
    chosen = votes.orderBy(F.xxhash64("doc_id")).limit(most)  # so few that they can be broadcast
    return documents.filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", (F.col("s") > 0).cast("int").alias("y"), (F.abs("s") > 1).alias("sure")).dropDuplicates(["doc_id"])


class Model:
    """Table of the language model and weights, both of fixed size; sent to the executors once."""

    def __init__(self, table: np.ndarray, weights: np.ndarray):
        self.table, self.weights = table.astype(np.float32), weights.astype(np.float32)


class Scorer:
    """Scores texts with a model, a batch at a time."""

    def __init__(self, model: Model):
        self.reader, self.w = Reader(LanguageModel({}, model.table)), model.weights

    def texts(self, texts: list[str | None]) -> np.ndarray:
        words: list[int] = []
        starts: list[int] = []
        doc: list[int] = []
        for i, t in enumerate(texts):
            if t:
                for p in self.reader.passages(t):
                    starts.append(len(words))
                    doc.append(i)
                    words += p
        out = np.zeros(len(texts))
        if starts:
            np.maximum.at(out, doc, judge(np.array(words, np.int64), np.array(starts), self.w))
        return out


def train(documents: DataFrame, reviews: DataFrame, most: int = TRAIN_DOCS, most_passages: int = TRAIN_PASSAGES, lexicon: bool = True) -> Model:
    """Language model from all documents, weights from the reviewed ones. Without reviews the lexicon is all there is.

    The driver holds at most most_passages passages of at most PASSAGE_WORDS words; equal ones of fine documents are one.
    """
    spark = documents.sparkSession
    table = gram_weights(documents)
    shared = spark.sparkContext.broadcast(table.astype(np.float32))  # fixed size

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(LanguageModel({}, shared.value))
        for b in batches:
            rows = [(d, y, s, np.array(p, np.int64).tobytes()) for d, y, s, t in zip(b["doc_id"], b["y"], b["sure"], b["text"]) for p in reader.passages(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "y", "sure", "p"])

    labelled = reviewed(documents, reviews, most)
    others = documents.filter(F.col("text").isNotNull()).join(reviews.select("doc_id"), "doc_id", "left_anti")
    few = F.broadcast(others.select("doc_id").orderBy(F.xxhash64("doc_id")).limit(UNREVIEWED_DOCS))
    unread = others.join(few, "doc_id").select("doc_id", "text", F.lit(-1).alias("y"), F.lit(False).alias("sure"))
    rows = labelled.unionByName(unread).mapInPandas(extract, "doc_id long, y int, sure boolean, p binary")
    rows = rows.groupBy("p", "y", F.when(F.col("y") == 1, F.col("doc_id")).alias("doc")).agg(F.count("*").alias("n"), F.max("sure").alias("sure"))
    got = rows.orderBy(F.desc("y"), F.xxhash64("p")).limit(most_passages).toPandas()
    parts = [np.frombuffer(p, np.int64) for p in got["p"]]
    starts = np.cumsum([0, *map(len, parts)])[:-1].astype(np.int64)
    words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    label = got["y"].to_numpy()
    doc = np.where(label == 1, got["doc"].fillna(0), -1 - np.arange(len(got))).astype(np.int64)
    return Model(table, fit(words, starts, doc, label, got["sure"].to_numpy(bool), got["n"].to_numpy(float), lexicon))


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of documents and `score`, 0..1, of the worst passage; 0 for null, empty and wordless texts."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # fixed size

    @F.pandas_udf("double")
    def worst(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(scorer.texts(texts.tolist()))

    return documents.withColumn("score", worst(F.col(text)))


def rates(scored: DataFrame, source: Column, threshold: float = THRESHOLD) -> DataFrame:
    """source, n_docs, n_flagged, rate, mean_score."""
    flag = (F.col("score") >= threshold).cast("long")
    return scored.groupBy(source.alias("source")).agg(F.count("*").alias("n_docs"), F.sum(flag).alias("n_flagged"), F.avg(flag).alias("rate"), F.avg("score").alias("mean_score"))
