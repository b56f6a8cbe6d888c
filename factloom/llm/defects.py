"""Broken prompt and response pairs: labelling functions for each defect, combined by a label model."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.labels import Ngrams, cutoff, fit, logistic, posterior, slope
from factloom.storage import cut

DEFECTS = ["empty", "refusal", "copied_question", "other_language", "truncated"]
#: Labelling functions of each defect, in the order in which votes() gives them.
FUNCTIONS = {"empty": 3, "refusal": 7, "copied_question": 3, "other_language": 3, "truncated": 5}
#: Words that a task counts before it hands them on, and tasks that a pass over the examples of endings has at most, as each
#: sends a slope of 1 MB.
WORDS, TASKS = 200_000, 64

# Words of four languages, fillers, labels and turns of phrase.
FUNCTION_WORDS = {
    "en": "the of and to in is was were are for with that this by from at as be or should has have not no any which what how can does why after before when if its it their between during without into under than then such there these those who also given yes only",
    "de": "der die das und ist ein eine einer eines einem einen nicht mit von für auf bei zu im in den dem des wird werden wurde sollen soll ohne nach gilt etwa wie welche welcher welches warum wenn als auch aus zur zum sind hat haben ja nein nur durch über unter oder kann darf",
    "fr": "le la les des du de un une et est dans pour avec par sur ne pas que qui au aux ce cette ces sont était a été chez lorsque quelle quel pourquoi comment il elle en sans sous ou où oui non seulement si pendant après réduit contient faut",
    "es": "el la los las del de un una y es en para con por no que se al lo su sus este esta son fue está cuál por qué cómo cuando si sin más como entre sí solo durante después cada debe junto existe contiene",
}
FILLERS = "na nan none null nil empty noanswer nooutput noresponse noprediction missing unknown tbd tba notavailable notapplicable blank undefined todo error void placeholder nothing keineantwort sansréponse sinrespuesta".split()
_FILLERS = frozenset(FILLERS)
LABELS = "answer answers prediction output outputs response responses result results final reference referenceoutput completion assistant ans antwort ausgabe réponse sortie respuesta salida smiles text value json html".split()
_LABELS = frozenset(LABELS)
_LABEL_RUN = re.compile("|".join(sorted(LABELS, key=len, reverse=True)))
_TAGS = re.compile(r"<[^<>]*>")
ASKED = re.compile(r"^\W*(?:you asked|the question (?:is|was)|question|prompt|user|re|q|frage|vraag|pregunta)\s*[:.-]\s*", re.I)
ANSWER_LABEL = re.compile(r"\W(?:answer|a|antwort|réponse|reponse|respuesta|r)\s*:\s*$", re.I)
_MARKUP = re.compile(r"<[^<>]*>|```\w*|[*_#`~|>{}\[\]()\"'“”„«»‘’:;.,!?/\\=+-]")
# Words that only say that there is nothing, in any combination of two or more.
_NOTHING = frozenset("no not none null nil na empty blank missing undefined unavailable unspecified nothing without kein keine leer aucun aucune vide sin ninguna ninguno vacío".split())
_THING = frozenset("content contents answer answers output outputs text data value values prediction response reply result results completion entry input available provided given generated returned recorded here at all yet inhalt antwort ausgabe contenu réponse texte contenido respuesta texto".split())
# A refusal is the speaker's: who speaks, and that the speaker can't, may not, would rather not, or passes on.
_SPEAKER = r"(?:I|we|me|us|my|our|mine|this (?:assistant|model|system|service|chat)|the (?:assistant|model)|an? (?:AI|assistant|language model)|ich|wir|mir|mich|uns|je|j['’]|nous|moi|yo|nosotros)(?=\W*\w|\W*[.!?,;])"
_UNABLE = r"(?:can(?:no|['’])?t\b|could ?n['’]?t|unable|not able|in no position|won['’]?t|will not|wouldn['’]?t|would not|do(?:es)? ?n['’o]t (?:have|know|feel|answer|respond|give|offer|provide|discuss)|am not|['’]m not|have no|must (?:not|decline)|may not|not (?:going|allowed|permitted|comfortable|qualified|authori[sz]ed|willing|prepared|in a position)|isn['’]?t|is not|kann\b[^.]{0,40}\bnicht|darf\b[^.]{0,40}\bnicht|möchte\b[^.]{0,40}\bnicht|ne (?:peux|puis|veux|suis)|no (?:puedo|podemos|debo|quiero|me es posible))"
# Verbs that say who speaks.
_OWN = r"\bno (?:puedo|podemos|debo|debemos|quiero|deseo)\b|\b(?:möchte|kann|darf|will|werde|können|dürfen) (?:ich|wir)\b[^.!?]{0,60}\b(?:nicht|kein\w*)\b|\b(?:ich|wir) (?:möchte|kann|darf|will|werde|können|dürfen)n?\b[^.!?]{0,60}\b(?:nicht|kein\w*)\b|\bje (?:ne (?:peux|puis|veux|souhaite)|préfère ne pas)\b|\bprefiero no\b"
_AVOID = r"(?:declin\w+|refus\w+|refrain\w*|abstain\w*|rather (?:not|leave|avoid|skip)|prefer (?:not|to (?:leave|avoid|stay|keep|skip|say nothing))|stay(?:ing)? (?:away|out|clear)|steer\w* clear|keep\w* (?:away|out of|clear)|avoid\w*|leave (?:it|this|that|the \w+) (?:there|at that|to|for|alone|open|unanswered)|pass on|skip (?:this|that|it)|hold back|no comment|not comment|say no more|have to stop)"
_BOUNDS = r"(?:(?:can|may|might|should|(?:am|are|is) (?:able|allowed|free) to) (?:discuss|say|answer|comment|help|share|talk|tell|give|offer)|remit|scope|purview|mandate|competence|expertise|polic(?:y|ies)|guidelines?|rules|terms of use|usage|instructions|permitted|allowed|appropriate|inappropriate|irresponsible|unethical|unsafe|improper|unwise|wrong|comfortable|role|denied|off[- ]limits|out of bounds)"
_REQUEST = r"(?:question|questions|request|requests|topic|topics|subject|subjects|matter|matters|enquiry|inquiry|query|prompt|answer|answering|answers|reply|comment|help|assist|assistance|advise|advice|respond|discuss|speculate|comply|opinion|frage|anfrage|question|demande|pregunta|solicitud)"
_ASKS = re.compile(rf"\b{_REQUEST}\b", re.I)
_INFO = r"(?:information|statement|comment|answer|reply|evidence|data|details?|context|guidance|opinion|advice)"
REFUSALS = [
    re.compile(rf"\b{_SPEAKER}\b[^.!?]{{0,30}}?(?<![\w]){_UNABLE}|{_OWN}", re.I),
    re.compile(rf"\b{_REQUEST}\b[^.!?]{{0,50}}?\b{_BOUNDS}\b|\b(?:outside|beyond|against|not|n['’]t|under|within) [^.!?]{{0,30}}?\b{_BOUNDS}\b|\b{_BOUNDS}\b (?:of|for) (?:me|us)\b|\b{_REQUEST} (?:is )?(?:not|denied|declined|refused|rejected|blocked)\b", re.I),
    re.compile(r"^\W*(?:(?:I['’]?m |I am |we['’]re )?(?:so |very |really )?(?:sorry|afraid)(?=\s*[,;.!:-]|\s+(?:but|I|we|that|to|about|this)\b)|my apolog|apologies|I apolog|unfortunately(?:,|\s+(?:I|we|this|that)\b)|as an? (?:ai|language model|assistant)|regrettably,|I regret|leider (?:kann|darf|ist|können)|bedaure|désolé|je regrette|lo siento|lamento|(?:es )?tut mir leid|no comment|request denied)", re.I),
    re.compile(r"\b(?:ask|see|consult|contact|refer to|speak (?:to|with)|talk to|turn to|check with|matter for|question for|best (?:put|left) to)\b[^.]{0,20}\b(?:your|an?|the)\b[^.]{0,15}\b(?:doctor|physician|pharmacist|professional|specialist|healthcare|provider|expert|clinician)|\bfragen sie [^.]{0,20}(?:arzt|apotheker)|\bconsultez\b[^.]{0,20}(?:médecin|pharmacien)|\bconsulte\b[^.]{0,20}(?:médico|farmacéutico)", re.I),
    re.compile(rf"\b(?:no|not enough|insufficient|too little) {_INFO}\b[^.]{{0,90}}?\b(?:can|could|from (?:me|us|my|our)|in the|to (?:answer|say|tell|judge|decide)|is (?:possible|available|given)|was (?:found|given))\b|\b(?:not|n['’]t|never) (?:stated|given|mentioned|provided|contained|found|described|answered|possible)\b[^.]{{0,20}}\b(?:in the (?:given|provided|supplied|label|sections?|context|text)|for an? (?:AI|assistant|model))|\b(?:can['’]?t|cannot|can not|could not) be (?:answered|told|said)\b|\bdo(?:es)? ?n['’o]t (?:give|state|say|mention|contain|cover|address|answer) (?:this|that|it|the answer)\b|\binsufficient (?:evidence|information|data|context)\b|\benough information\b", re.I),
    re.compile(rf"\b{_SPEAKER}\b[^.!?]{{0,40}}?\b{_AVOID}\b|\b{_AVOID}\b[^.!?]{{0,40}}?\b(?:{_REQUEST}|{_SPEAKER})\b|^\W*(?:declined|refused|pass|no comment)\b", re.I),
    re.compile(rf"\b{_SPEAKER}\b|{_OWN}", re.I),
]
# Texts without any of these words hold nothing that the patterns above look for.
_ASKED_OF = frozenset("podemos debo debemos quiero deseo prefiero préfère möchte könnte können dürfen i we me us my our mine ai assistant model system service ich wir mir mich uns je j nous moi yo nosotros sorry afraid apologies apology unfortunately regrettably regret leider bedaure désolé siento lamento leid comment reply denied declined refused decline refuse topic topics subject request requests question questions answer answering answered policy policies guidelines remit scope irresponsible inappropriate doctor physician pharmacist professional specialist provider expert clinician arzt apotheker médecin pharmacien médico farmacéutico information insufficient statement stated evidence context tell said possible prefer pass puedo peux kann darf".split())
# I followed by "of", "type" or a number is no person.
_NOT_PERSON = re.compile(r"\b(?:type|factor|class|phase|stage|grade|group|part|category|level|angiotensin|study|trial|table)\s+I\b|\bI (?:of|type|and II|or II|\d)", re.I)
_MOLECULE = re.compile(r"^\W*(?:smiles\W+)?[A-Za-z0-9@\[\]()=#+\\/.%-]{6,}\W*(?:\(from the label\))?\W*$", re.I)
_NUMBER = re.compile(r"^\W*(?:(?:about|the value is|approximately|ca|value)\W+)?-?\d+(?:[.,]\d+)?\s*(?:\(?[a-z%/]+(?: [a-z]+)?\)?)?\W*$", re.I)
_TERMINAL = re.compile(r"[.!?…。]['\"”’»)\]*_`]*$|[)\]”\"»]$")
_DANGLING = re.compile(r"(?:[,;:(\[{/&–—=#]|\s-|\b(?:e\.g|i\.e|z\. ?b|p\. ?ex|vs|incl|approx)\.?,?|\n\s*(?:[-*•]|\d+[.)])\s*|(?:^|\s)\d+[.)])$")
_SIGNS = {"de": re.compile("[äöüß]"), "fr": re.compile("[èêëçàâîïôûœù]"), "es": re.compile("[ñ¿¡íóáú]")}
_ENDS_OPEN = frozenset("the a an of and or to in with for from by at on as is was were are be that than when if but not der die das und oder von mit bei für ein eine zu den dem des im in ist wird le la les des du de un une et ou à au avec pour dans par est que el los las del y o con por para en al se que su".split())
MODEL_LANGUAGES = list(FUNCTION_WORDS)
_IN: dict[str, list[int]] = {}
for _i, _ws in enumerate(FUNCTION_WORDS.values()):
    for _w in set(_ws.split()):
        _IN.setdefault(_w, []).append(_i)


def plain(text: str | None) -> str:
    """Composed, without invisible signs, blanks as single blanks."""
    t = text or ""
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKC", t) if c < "\x7f" or unicodedata.category(c) != "Cf")
    return " ".join(t.split())


def _only(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.casefold())


def function_language(words: list[str]) -> str | None:
    """The language whose function words are most frequent, if it leads clearly."""
    n = [0, 0, 0, 0]
    for w in words:
        for i in _IN.get(w, ()):
            n[i] += 1
    most = max(n)
    return MODEL_LANGUAGES[n.index(most)] if n.count(most) == 1 else None


def sign_language(text: str) -> str | None:
    if text.isascii():
        return None
    n = sorted(((len(p.findall(text)), lang) for lang, p in _SIGNS.items()), reverse=True)
    return n[0][1] if n[0][0] > n[1][0] else None


def _hash(*parts: object) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode()) & 0x1FFFF


def ending_features(text: str, known: frozenset[str]) -> list[int]:
    """Eight features: of the last three words, and of how their sentence begins."""
    sentences = re.split(r"[.!?]\s", text.casefold())
    words = re.findall(r"[^\s.!?\"“”]+", text.casefold())
    begin = (words if len(sentences) == 1 else re.findall(r"[^\s.!?\"“”]+", sentences[-1]))[:6]
    w = ["", "", "", *words][-3:]
    shape = lambda x: x if x in known else "9" if re.fullmatch(r"[\d.,-]+", x) else "#" + x[-3:] if len(x) > 5 else "~" + str(len(x))
    c = [shape(x) for x in w]
    return [_hash(1, c[2]), _hash(2, c[1], c[2]), _hash(3, *c), _hash(4, c[0], c[1]), _hash(5, w[2][-3:], w[2] in known), _hash(6, min(len(w[2]), 9), w[2] in known), _hash(7, c[1]), _hash(8, *[x for x in map(shape, begin) if x[0] not in "#9~"][:3], c[1], c[2])]


def _letters(text: str) -> np.ndarray:
    c = np.frombuffer(f"  {' '.join(_only(text))} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique((c[:-2] * 73_856_093 ^ c[1:-1] * 19_349_663 ^ c[2:] * 83_492_791) & 0x1FFFF)


def _grams(texts: list[list[str]]) -> np.ndarray:
    """_letters() of each text of the given words, with the text's number before them."""
    part = [f"  {' '.join(words)} " for words in texts]
    c = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(part)), [len(t) for t in part])
    whole = owner[:-2] == owner[2:]
    gram = (c[:-2] * 73_856_093 ^ c[1:-1] * 19_349_663 ^ c[2:] * 83_492_791) & 0x1FFFF
    return np.unique((owner[:-2][whole] << 17) | gram[whole])


def _sentences(text: str) -> list[str]:
    """The sentences of a text that end with their stop, each of twelve signs and two words at least."""
    t = plain(text)
    found = re.finditer(r"[^.!?]+(?:[.!?]|$)", t)
    return [s for m in found if len(s := m[0]) > 12 and s[-1] in ".!?" and t[m.end() : m.end() + 1] in ("", " ") and " " in s.strip()]


def _endings(text: str, owner: str, known: frozenset[str]) -> list[list[int]]:
    """Features and, last, 1 if cut, of each sentence without its stop and of two cuts of it; where follows from a hash."""
    out = []
    for s in _sentences(text):
        s = s.strip().rstrip(".!?")
        out.append([*ending_features(s, known), 0])
        blanks, least = [m.start() for m in re.finditer(" ", s)][1:], len(s) // 4
        d = hashlib.sha1(f"{owner}\x1f{s}".encode()).digest()
        for i in (0, 10):
            where = int.from_bytes(d[i + 1 : i + 10], "big")
            at = blanks[where % len(blanks)] if blanks and d[i] < 128 else least + where % max(len(s) - 1 - least, 1)
            out.append([*ending_features(s[:at].rstrip(), known), 1])
    return out


def _frequent(count: dict[str, int], sentences: int) -> frozenset[str]:
    return frozenset(w for w, n in count.items() if n >= max(5, sentences // 4000))


class Seen:
    """What the models take from all texts: how many of each language hold three letters, how many sentences a word."""

    def __init__(self):
        self.letters = np.zeros((len(MODEL_LANGUAGES), 1 << 17), np.int64)
        self.words: Counter[str] = Counter()
        self.sentences = 0

    def add_texts(self, texts: list[str]) -> None:
        by: list[list[tuple[list[str], int]]] = [[] for _ in MODEL_LANGUAGES]
        for t, times in Counter(texts).items():
            words = _only(plain(t))
            if lang := function_language(words):
                by[MODEL_LANGUAGES.index(lang)].append((words, times))
        for n, own in zip(self.letters, by):
            for a in range(0, len(own), 2000):
                each, times = _grams([words for words, _ in own[a : a + 2000]]), np.array([times for _, times in own[a : a + 2000]])
                n += np.bincount(each & 0x1FFFF, times[each >> 17], 1 << 17).astype(np.int64)

    def add_sentences(self, texts: list[str]) -> None:
        for t in texts:
            for s in _sentences(t):
                self.sentences += 1
                self.words.update(set(re.findall(r"[^\s.!?\"“”]+", s.casefold())))


class Endings:
    """Tells whole sentences without their stop from cut ones; fitted on sentences that are cut at random."""

    def __init__(self, texts: list[str]):
        seen = Seen()
        seen.add_sentences(texts)
        self.known = _frequent(seen.words, seen.sentences)
        rows = np.array([x for i, t in enumerate(texts) for x in _endings(t, str(i), self.known)], np.int32).reshape(-1, 9)
        self.model = Ngrams()
        self.model.w = logistic(lambda w: slope(w, rows[:, :8], rows[:, 8]))

    @classmethod
    def of(cls, known: frozenset[str], w: np.ndarray) -> Endings:
        new = cls.__new__(cls)
        new.known, new.model = known, Ngrams()
        new.model.w = w
        return new

    def cut(self, text: str) -> float:
        return float(self.model.score(np.array([ending_features(text, self.known)]))[0])


class Languages:
    """Naive Bayes over letter trigrams, from texts whose function words leave no doubt."""

    def __init__(self, texts: list[str], letters: np.ndarray | None = None):
        """letters: those that are known already of more texts, as Seen counts them."""
        self.kept: dict[str | None, tuple] = {}
        seen = Seen()
        seen.add_texts(texts)
        n = 1.0 + seen.letters + (0 if letters is None else letters)
        self.log = np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)

    def asked(self, question: str | None) -> tuple[str, list[str], str | None]:
        """The plain question, its words and its language; kept, as a question has several answers."""
        if question not in self.kept:
            if len(self.kept) > 20_000:
                self.kept.clear()
            text = plain(question)
            words = _only(text)
            self.kept[question] = text, words, function_language(words) or self.of(text) or sign_language(text.casefold())
        return self.kept[question]

    def of(self, text: str) -> str | None:
        at = _letters(text)
        score = np.sort(s := self.log[:, at].sum(axis=1))
        return MODEL_LANGUAGES[int(np.argmax(s))] if len(at) >= 8 and score[-1] - score[-2] > 4 else None


    def of_all(self, texts: list[str]) -> list[str | None]:
        """of() of each text, for all at once."""
        out: list[str | None] = [None] * len(texts)
        for a in range(0, len(texts), 2000):
            each = _grams([_only(t) for t in texts[a : a + 2000]])
            starts = np.flatnonzero(np.r_[True, np.diff(each >> 17) > 0]) if len(each) else np.zeros(0, int)
            if not len(starts):
                continue
            score = np.add.reduceat(self.log[:, each & 0x1FFFF], starts, axis=1)
            order = np.sort(score, axis=0)
            sure = (np.diff(np.r_[starts, len(each)]) >= 8) & (order[-1] - order[-2] > 4)
            for i, k in zip((each[starts] >> 17)[sure].tolist(), score.argmax(axis=0)[sure].tolist()):
                out[a + i] = MODEL_LANGUAGES[k]
        return out


def votes(question: str | None, answer: str | None, task: str | None, endings: Endings, languages: Languages, letters: str | None = "?") -> list[int]:
    """The votes of all functions, those of each defect together. letters: the language of the answer by its letters, if known."""
    text = plain(answer)
    words = _only(text)
    asked, q, want = languages.asked(question)
    untagged = _TAGS.sub(" ", text) if "<" in text else text
    inner_words = _only(untagged) if untagged is not text else words
    unlabelled = [w for w in inner_words if w not in _LABELS]
    # A text of many words can be no filler.
    bare = "".join(_only(_MARKUP.sub(" ", untagged))) if len(unlabelled) < 12 else "." * 40
    own = [w for w in words if w not in _LABELS or w in _THING] if len(words) < 20 else words
    filler = "".join(unlabelled) in _FILLERS or bare in _FILLERS or (1 < len(own) < 7 and not _NOTHING.isdisjoint(own) and not _THING.isdisjoint(own) and all(w in _NOTHING or w in _THING for w in own))
    rest = _LABEL_RUN.sub("", bare) if len(bare) < 40 else bare
    out = [1 if not text else -1, int(not unlabelled or filler), int(not rest or filler)]
    empty = max(out)

    # Refusals
    if (task or "").strip().casefold() == "refusal":
        out += [0] * 7
    elif _ASKED_OF.isdisjoint(words):
        out += [-1] * 5 + [-1, 0]
    else:
        bare_ = _NOT_PERSON.sub(" ", text)
        hits = [bool(p.search(bare_)) for p in REFUSALS]
        # What only a speaker can refuse is none where nobody speaks; a long text that speaks somewhere says little.
        speaks, asks = hits[6], bool(_ASKS.search(text))
        out += [(1 if speaks or i in (2, 4) or (i == 1 and asks) else 0) if hit else -1 for i, hit in enumerate(hits[:6])]
        out += [1 if speaks and len(words) < 60 else -1 if speaks else 0 if not any(hits[:6]) else -1]

    # The question and nothing more
    core = text
    for _ in range(3):
        core = ANSWER_LABEL.sub("", ASKED.sub("", core)).strip()
    c = _only(core)
    times = len(c) // len(q) if q and len(c) % len(q) == 0 else 0
    same = bool(q) and bool(c) and c == q
    again = bool(q) and times > 1 and c == q * times
    near = bool(q) and bool(c) and set(c) == set(q) and len(c) in range(max(1, len(q) - 1), 2 * len(q) + 2)
    out += [int(same or again), int(near) if c else -1, 1 if same or again else 0 if q and len(set(c) - set(q)) > 1 else -1]
    copied = same or again

    # Language
    bland = bool(empty or not words or _NUMBER.match(text) or (_MOLECULE.match(text) and (re.search(r"[=#()\[\]]", text) or " " not in text)))
    if bland or copied or not want:
        out += [-1 if not empty else 0, 0 if bland else -1, -1]
    else:
        vote = lambda lang: -1 if lang is None else int(lang != want)
        letters = languages.of(text) if letters == "?" else letters
        signs = sign_language(text.casefold())
        out += [vote(function_language(words)), vote(letters), vote(signs) if signs else -1]

    # Endings
    raw = re.sub(r"[^\S\n]+", " ", (answer or "") if (answer or "").isascii() else unicodedata.normalize("NFKC", answer)).rstrip(" \n\t")
    number = bool(_NUMBER.match(text))
    molecule = bool(_MOLECULE.match(text)) and " " not in core.split(":")[-1].strip() and bool(re.search(r"[=#()\[\]]|[Cc]{2}", text))
    if empty or not words or number or copied:
        out += [0, 0, 0, 0, 0]
    else:
        inner = re.sub(r"[\s\"”’»'*_`]+$", "", text)
        open_ = any(inner.count(a) > inner.count(b) for a, b in ("()", "[]", "{}", "“”")) or raw.count("```") % 2 == 1
        dangling = bool(_DANGLING.search(inner) or _DANGLING.search(raw) or _DANGLING.search((answer or "").rstrip(" ")))
        ended = bool(_TERMINAL.search(text)) and not dangling
        p = 0.0 if ended or molecule or len(words) < 4 else endings.cut(inner)
        last = words[-1] if words else ""
        out += [
            -1 if molecule else 0 if ended else 1 if p > 0.6 else 0 if p < 0.3 else -1,
            1 if dangling else -1,
            1 if not ended and last in _ENDS_OPEN and len(words) > 3 else -1,
            1 if open_ else -1,
            0 if ended and not open_ else 0 if molecule and not open_ else 1 if p > 0.9 else -1,
        ]
    return out


def models_of(flat: DataFrame) -> tuple[Endings, Languages]:
    """The models of endings and languages from all rows: k, field_name, q, a.

    Counts are summed by Spark; only those of letters (a fixed number) and the words that one sentence in 4,000 has, but five
    at least, reach the driver. The examples of endings are written once and read in each pass of the fit. All sums are whole
    numbers, so the models don't depend on how the rows lie.
    """
    spark = flat.sparkSession

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()

        def taken() -> pa.RecordBatch:
            kind, gram = np.nonzero(seen.letters)
            words = [*seen.words]
            kinds = np.r_[kind, np.full(len(words), 4), 5].astype(np.int32)
            names = pa.array([None] * len(kind) + words + [None], pa.string())
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.r_[gram, np.zeros(len(words) + 1)].astype(np.int32)), names, pa.array(np.r_[seen.letters[kind, gram], np.fromiter(seen.words.values(), np.int64, len(words)), seen.sentences].astype(np.int64))], names=["kind", "gram", "word", "n"])

        for batch in batches:
            q, a = ([t for t in c.to_pylist() if t] for c in batch.columns)
            seen.add_texts(q + a)
            seen.add_sentences(a)
            if len(seen.words) > WORDS:
                yield taken()
                seen = Seen()
        yield taken()

    counted = cut(flat.select("q", "a").mapInArrow(counts, "kind int, gram int, word string, n long").groupBy("kind", "gram", "word").agg(F.sum("n").alias("n")))
    sentences = counted.where("kind = 5").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    some = counted.where(F.col("kind") == 4).where(F.col("n") >= max(5, sentences // 4000)).select("word", "n").toArrow()
    known = _frequent(dict(zip(some["word"].to_pylist(), some["n"].to_pylist())), sentences)
    some = counted.where("kind < 4").select("kind", "gram", "n").toArrow()
    letters = np.zeros((len(MODEL_LANGUAGES), 1 << 17), np.int64)
    letters[some["kind"].to_numpy(), some["gram"].to_numpy()] = some["n"].to_numpy()

    usual = spark.sparkContext.broadcast(known)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([x for owner, t in zip(*(c.to_pylist() for c in batch.columns)) if t for x in _endings(t, owner, usual.value)], "<i4").reshape(-1, 9)
            yield pa.RecordBatch.from_arrays([pa.array([rows[i : i + 256].tobytes() for i in range(0, len(rows), 256)], pa.binary())], names=["x"])

    made = cut(flat.select(F.concat_ws("\x1f", F.col("k").cast("string"), "field_name").alias("owner"), "a").mapInArrow(examples, "x binary")).coalesce(TASKS)
    usual.destroy()

    def slopes(w: np.ndarray) -> np.ndarray:
        now = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(now.value) + 1, np.int64)
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(-1, 9)
                total += slope(now.value, x[:, :8], x[:, 8])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

        out = np.zeros(len(w) + 1, np.int64)
        for part in made.mapInArrow(run, "s binary").toArrow()["s"].to_pylist():
            out += np.frombuffer(part, np.int64)
        now.destroy()
        return out

    return Endings.of(known, logistic(slopes)), Languages([], letters)


def defects(rows: DataFrame, key: str = "pred_id", fields: list[str] = ["prediction", "reference_output"], question: str = "question", task: str = "task_type", version: str = "loaded_at") -> DataFrame:
    """key, field_name, defect, posterior, cutoff: a row for each defect of each field, with how sure the label model is.

    Of repeated keys the latest version counts; null keys are left out. Null questions are copied by nothing and set no
    language, a null task type is no refusal task. The reliabilities are fitted on the vote patterns of all rows; cutoffs
    are validated: each is the mean of those that two halves of the rows get from a model fitted on the other half. The
    models of endings and of languages, which some functions ask, are fitted on all rows, too.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    latest = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max_by(F.struct(F.col(question).alias("q"), F.col(task).alias("t"), *(F.col(f).alias(f"f{i}") for i, f in enumerate(fields))), F.struct(F.coalesce(F.col(version).cast("string"), F.lit("")), F.xxhash64(*fields))).alias("x")).select("k", "x.*")
    flat = cut(latest.select("k", "q", "t", F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"f{i}").alias("a")) for i, f in enumerate(fields)))).alias("y")).select("k", "q", "t", "y.*"))
    models = spark.sparkContext.broadcast(models_of(flat))
    offsets = np.cumsum([0, *FUNCTIONS.values()])

    @F.pandas_udf("array<tinyint>")
    def vote(q: pd.Series, a: pd.Series, t: pd.Series) -> pd.Series:
        endings, languages = models.value
        letters = languages.of_all([plain(x) for x in a])
        return pd.Series([votes(*x, endings, languages, l) for *x, l in zip(q, a, t, letters)])

    voted = cut(flat.select("k", "field_name", vote("q", "a", "t").alias("v")))
    each = voted.select("k", "field_name", F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.slice("v", int(offsets[i]) + 1, int(FUNCTIONS[d])).alias("p")) for i, d in enumerate(DEFECTS)))).alias("x")).select("k", "field_name", "x.*")
    patterns: dict[str, list] = {d: [] for d in DEFECTS}
    half = F.pmod(F.xxhash64("k", "field_name", F.lit(2)), F.lit(2))
    for r in each.groupBy("defect", "p").agg(F.count_if(half == 0).alias("a"), F.count_if(half == 1).alias("b")).collect():  # at most 3 ** 7 a defect
        patterns[r["defect"]].append((list(r["p"]), r["a"], r["b"]))
    known = []
    for d, seen in patterns.items():
        if seen:
            p, c = np.array([x[0] for x in seen]), np.array([x[1] + x[2] for x in seen], float)
            # Where no function says yes there is no defect.
            model = lambda w: np.where((p == 1).any(axis=1), posterior(p, *fit(p, w)), 0.0)
            # Each half's model is judged by that of the other, so no cutoff is chosen by the rows that it was fitted on.
            halves = [np.array([x[1 + h] for x in seen], float) for h in (0, 1)]
            fitted = [model(w) for w in halves]
            least = float(np.mean([cutoff(fitted[h], halves[1 - h], fitted[1 - h]) for h in (0, 1)]))
            post = model(c)
            known += [(d, [int(v) for v in x], float(y), least) for x, y in zip(p, post)]
    table = F.broadcast(spark.createDataFrame(known, "defect string, p array<tinyint>, posterior double, cutoff double"))
    return each.join(table, ["defect", "p"]).where(F.col("posterior") >= F.col("cutoff")).select(F.col("k").cast(kind).alias(key), "field_name", "defect", "posterior", "cutoff")


def one_defect(found: DataFrame, key: str = "pred_id") -> DataFrame:
    """key, field_name, defect: the one defect of a field, that which excludes the others: empty before refusal before
    copied_question before other_language before truncated."""
    order = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    best = Window.partitionBy(key, "field_name").orderBy(order)
    return found.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, "field_name", "defect")
