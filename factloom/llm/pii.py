"""Personal information in free text: regex, gazetteer and context labellers vote on candidate spans, expectation
maximisation estimates how reliable they are, and a span classifier trained on its posteriors decides."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.defects import FUNCTION_WORDS
from factloom.llm.labels import Ngrams, fit, posterior
from factloom.storage import cut

TYPES = ["email", "phone", "id_number", "address", "name"]
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Candidates that the span classifier is trained on, about; drawn by a hash.
SAMPLE = 60_000
#: Given names that are sent to every task, at most.
MOST_NAMES = 2_000_000
#: A word in more than this part of the texts, by three standard deviations, is a common word.
COMMON = 0.004
#: A type of which fewer candidates are drawn is decided by the label model.
FEW = 20
FEATURES = 12
#: Share of true ones among the candidates that the estimation starts from.
PRIOR = {"email": 0.95, "phone": 0.4, "id_number": 0.3, "address": 0.95, "name": 0.3}
#: The vote that rules a candidate out by definition, as the name of a syndrome, study or institution or a product number.
VETO = {"phone": 3, "id_number": 3, "name": 5}

# Cues of the labellers, in four languages.
_AT = r"(?:\s?(?:@|＠|\(at\)|\[at\]|\{at\}|\(@\)|\[@\])\s?)"
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|\(punkt\)|\[punkt\])\s?)"
EMAIL = re.compile(rf"(?<![\w.+%-])\w[\w.+%-]*(?<=[\w+]){_AT}[^\W_](?:[\w-]*[^\W_])?(?:{_DOT}[^\W_](?:[\w-]*[^\W_])?)+|(?<![\w.+%-])\w[\w.+%-]*\sat\s[\w-]+(?:\sdot\s[\w-]+)+", re.I)
PHONE = re.compile(r"(?<![\w+.,/(-])(?:\(\+?\d{1,4}\)|\+?\d{1,5})(?:[ \xa0.\-/]{1,2}\(?\d{1,8}\)?|\(\d{1,5}\)|\d{6,11}){1,6}(?![\w(])(?!\.\d|[-/]\d)|(?<![\w+.,/(-])(?:\+|00)\d{8,14}(?!\w)")
ID = re.compile(r"(?<![\w.,/-])(?:[A-Z]{1,3}[ -]?)?\d(?:[ -]?\d){5,11}(?:[ -]?[A-Z])?(?![\w])(?!-\w|\.\d|/\d)")
_UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Floor)\s?\d+\s?[A-Z]?"
_TOWN = r"[A-ZÀ-Þ][a-zß-ÿ'’]+(?:-(?:[a-z]+-)?[A-ZÀ-Þ][a-zß-ÿ'’]+)*"
_POST = r"(?:[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2}|[A-Z]{2}\s\d{5}(?:-\d{4})?|\d{5})\b"
_KIND = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Close|Way|Place|Pl\.?|Square|Sq\.?|Boulevard|Blvd\.?|Terrace|Crescent|Gardens|Row|Grove|Mews|Walk|Parade|Rise|Green)"
ADDRESS = [
    re.compile(rf"(?<![\w-])(?:{_UNIT},\s)?\d{{1,5}}[A-Za-z]?\s(?:[A-ZÀ-Þ][\w'’-]+\.?\s){{1,4}}?{_KIND}(?:,\s{_UNIT})?,?\s(?:{_TOWN}(?:\s[A-Z][a-z]+(?=,?\s{_POST}))?)(?:,?\s{_POST})?"),
    re.compile(rf"(?<![\w-])(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer|hof|steig|pfad|markt)|(?:Am|An der|An den|Im|In der|Zum|Zur|Auf der|Auf dem|Unter den|Alter?|Kurze|Lange|Neue|Große|Kleine|Hohe)\s[A-ZÄÖÜ][\wäöüß-]+(?:\s[A-ZÄÖÜ][\wäöüß-]+)?)\s\d{{1,4}}\s?[a-z]?,\s\d{{5}}\s{_TOWN}"),
    re.compile(rf"(?<![\w-])\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|route|cours|square|passage|sentier)\s[^,\n]{{2,40}},\s\d{{5}}\s{_TOWN}", re.I),
    re.compile(rf"(?<![\w-])(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Carretera|Ronda|Travesía|Rambla|Callejón)\s[^,\n]{{2,40}},\s(?:n\.?º\s)?\d{{1,4}}[A-Z]?(?:,\s\d+\.?º\s?\w?)?,\s\d{{5}}\s{_TOWN}"),
]
_C = lambda words: re.compile(rf"(?:^|[^\w])(?:{words})[\s:=|.,\"'(<#-]*$", re.I)
PHONE_BEFORE = _C(r"tel|tél|phone|telefon|teléfono|téléphone|mobile|mobil|móvil|portable|handy|cell|fax|fax and phone|call|call on|called|rang from|ring(?: back)? on|ring|dial|line|hotline|rückruf unter|anruf unter|unter|appeler le|appelez le|llamar al?|llame al|whatsapp|sms|contact")
PHONE_AFTER = re.compile(r"^[\s,;.)(]*(?:ext\b|extension|durchwahl|poste \d|mobile|home|work|office|direct|ward|(?:any ?time|before|after|between|from|until|weekdays?|daily|ab|nach|vor|zwischen|werktags|am (?:vormittag|nachmittag|abend)|avant|après|entre|antes|después|desde)\b)", re.I)
PHONE_SHAPE = re.compile(r"\+\d|00\d\d|\(\+?\d{2,5}\)|1?-?\d{3}[-. ]\d{3}[-. ]\d{3,4}$|0\d|1-\d{3}-")
ID_BEFORE = _C(r"ssn|social security(?: no| number)?|mrn|record(?: number| no)?|passport(?: no| number)?|ausweis(?:nummer|nr)?|reisepass(?:nummer)?|versicherten(?:nummer|nr)?(?: lautet)?|versicherungsnummer|member(?:ship)?(?: id| no| number)?|health card|patient(?: number| no| id|ennummer|en-nr)|insurance(?: number| no)?|nhs(?: number| no)?|numéro de (?:dossier|sécurité sociale|patient)|dossier|carte (?:de santé|vitale|d'identité)|número de (?:historia|paciente|afiliado|seguridad social)|historia|tarjeta sanitaria|dni|nie|nif|nir|pasaporte(?: n.?)?|passeport(?: n.?)?|identity(?: card| number| no)?|national id|id(?: no| number)?|chart(?: number| no)?|svnr|krankenkasse(?:nnummer)?|subject(?:[ _](?:no|number|id))?")
ID_AFTER = re.compile(r"^[\s,;.)]*(?:(?:is|was|were|has been|had been|lag|liegt|wurde|ist|est|figure|a été|es|fue|consta)\b|admitted|issued|valid|expires)", re.I)
ID_SHAPE = re.compile(r"\d{3}([- ])\d\d\1\d{4}$|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]$|[A-Z]\d{7,9}$|[A-Z]-\d{4}-\d{3}$|\d{4} \d{3} \d\d-\d$|\d{8}[A-Z]$")
NOT_PERSON_BEFORE = _C(r"lot|batch(?: of)?|trial|study|pmid|pmc|doi|cas|ndc|rows?|code|nct|isbn|issn|eudract|patent|product|version|serial(?: no| number)?|model|chapter|section|table|figure|page|ward|bed|isrctn|item|order|invoice|ref|set at|held|estudio|studie|étude|charge|lote|in study")
ADDRESS_BEFORE = _C(r"address|lives at|living at|deliver to|visit at|sent to|back from|house at|adresse|wohnhaft in|wohnt in|habite|domicile|vive en|domicilio|dirección|anschrift|resides at|home|addr|post to|ship to")
NAME_TITLE = re.compile(r"(?:^|[^\w=])(?:mr|mrs|ms|miss|dr|prof|herr|herrn|frau|mme|mlle|m|monsieur|madame|señora?|sra?|don|doña|nurse|sister|schwester|pfleger|patient|patiente|patientin|paciente|doctor|docteur|doctora|professor|sir|lady)\.?\s$", re.I)
NAME_BEFORE = _C(r"signed|signé|signature|gezeichnet|firmado|name|nom|nombre|contact_person|contact|witness|reported by|filed by|written by|according to|spoke with|left with|asked by|seen by|regards|wishes|grüße|saludos|cordialement|on duty|sincerely|reporter|author")
NAME_AFTER = re.compile(r"^[\s,]*(?:(?:has|had|have|and (?:his|her|their)|who|whose)\b|reported|noted|called|complained|described|mentioned|phoned|confirmed|denied|visited|returned|stopped|started|took|gave|asked|said|wrote|told|rang|felt|was (?:seen|admitted|given|born|told|asked)|klagte|meldete|sagte|berichtete|erzählte|rief|nahm|bat|hat\b|wurde\b|a (?:signalé|arrêté|dit|pris|appelé|demandé|indiqué)|dejó|avisó|dijo|llamó|tomó|pidió|refirió)", re.I)
NOT_NAME_AFTER = re.compile(r"^(?:'s)?[\s-]*(?:syndrome|disease|scale|sign|test|score|index|study|trial|cohort|clinic|hospital|institute|institut|university|centre|center|foundation|pharma|laborator|street|road|avenue|method|criteria|reaction|maneuver|manoeuvre|procedure|classification|krankheit|klinik|hôpital|clinique|clínica|hospital|met (?:its|the)|(?:enrol|recruit|randomi[sz])\w+|II\b|III\b|IV\b|\d|-\d|group|consortium|effect|staining|equation)", re.I)
NOT_NAME_BEFORE = re.compile(r"(?:^|[^\w])(?:study|trial|model|lot|batch|code|the|cohort|estudio|studie|étude|project|system)\s$", re.I)
SENTENCE_WORDS = frozenset("neither nor while because since although however also both either each every please thanks dear hello best kind warm yours until again still later today yesterday ja nein liebe lieber mit estimado estimada cher chère bonjour hola dijo she he her his we they you member id record health card passport number national insurance call mobile telefon send study asked signed contact reporter witness phone mail email tel fax address name".split())
_CAP = r"(?:[A-ZÀ-Þ](?:[^\W\d_]|['’])+(?:-[A-ZÀ-Þ](?:[^\W\d_]|['’])+)*(?![\w(\[#=@]))"
_PARTICLES = "de la|de las|de los|del|de|da|das|dos|do|di|della|du|des|le|la|van der|van den|van de|van|von der|von|zu|zur|ter|ten|bin|ibn|al|el|y|e"
RUN = re.compile(rf"(?<![\w@.#/-])(?:{_CAP}|[A-ZÀ-Þ]\.)(?:(?:,[ \xa0]|[ \xa0](?:(?:{_PARTICLES})[ \xa0])?)(?:{_CAP}|[A-ZÀ-Þ]\.))*")
TOKEN = re.compile(rf"{_CAP}|[A-ZÀ-Þ]\.")
_TITLES = frozenset("mr mrs ms miss dr prof herr herrn frau mme mlle monsieur madame señor señora sr sra don doña nurse sister schwester pfleger patient patiente patientin paciente doctor docteur doctora professor sir lady".split())


_INSIDE = re.compile(r"(?:^|[^\w-])[^\W\d_A-ZÀ-Þ][^\W\d_]*[ \xa0]$")
_CUE_WORDS = frozenset(w.casefold() for p in (PHONE_BEFORE, ID_BEFORE, NOT_PERSON_BEFORE, ADDRESS_BEFORE, NAME_BEFORE) for w in re.findall(r"[^\W\d_]{3,}", p.pattern))
# Ends of the text before a name that are worth the patterns above.
_STOPS = " :=|.,\"'(<#-\t\xa0\n"
_TITLE_ENDS = _TITLES | {"m"}
_CUE_ENDS = frozenset("signed signé signature gezeichnet firmado name nom nombre contact_person contact witness by to with wishes grüße saludos cordialement regards duty sincerely reporter author".split())
_STUDY_ENDS = frozenset("study trial model lot batch code the cohort estudio studie étude project system".split())
_BEFORE = _TITLE_ENDS | _CUE_ENDS | _STUDY_ENDS
_EMAIL_LIKE = r"(?<![^\s@＠\[({])[^\s@＠\[({]++\s?(?:[@＠]|[\[({](?:at|@)[\])}])\s?\S+|(?<!\S)\S++\sat\s\S++\sdot\s\S+"
# A phone or identity number has six figures at least with few signs between them, an address a figure.
_DIGITS = re.compile(r"\d(?:[^\w\n]{0,3}[A-Z]?\d){5}")
_FIGURE = re.compile(r"\d")
_POSTCODE = re.compile(r"\d{5}\s")
_AT_SIGN = re.compile(r"[＠]|[\[({]@?at[\])}]|\w\s?@\s?\w|\sdot\s", re.I)


def _hash(*parts: object) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode()) & 0x1FFFF


def _around(text: str, a: int, b: int) -> tuple[str, str, list[str], list[str]]:
    left, right = text[max(0, a - 40) : a].replace("\n", " "), text[b : b + 40].replace("\n", " ")
    return left, right, ["", "", *re.findall(r"[^\W_]+|[^\w\s]", left)][-2:], [*re.findall(r"[^\W_]+|[^\w\s]", right)[:2], "", ""][:2]


def _features(kind: str, value: str, w1: list[str], w2: list[str], extra: tuple, votes: list[int]) -> list[int]:
    l, r = [w.casefold() for w in w1], [w.casefold() for w in w2]
    shape = re.sub(r"[a-zß-ÿ]+", "a", re.sub(r"[A-ZÀ-Þ]{2,}", "B", re.sub(r"\d+", lambda m: f"9{min(len(m[0]), 9)}", value)))[:40]
    return [_hash(kind, i, *x) for i, x in enumerate([(l[1],), (l[0], l[1]), (r[0],), (r[0], r[1]), (l[1], r[0]), (shape,), (*votes,), *[(e,) for e in extra]][:FEATURES])] + [_hash(kind, "pad", i) for i in range(FEATURES - 7 - len(extra))]


def _cues(text: str, a: int) -> tuple[bool, bool, bool]:
    """Whether the text before a name ends in a title, a cue of a name or a word before what is no name."""
    end = text[max(0, a - 24) : a].rstrip(_STOPS)
    j = len(end)
    while j and (end[j - 1].isalnum() or end[j - 1] == "_"):
        j -= 1
    word = end[j:].casefold()
    if word not in _BEFORE:
        return False, False, False
    left = text[max(0, a - 40) : a].replace("\n", " ")
    return word in _TITLE_ENDS and bool(NAME_TITLE.search(left)), word in _CUE_ENDS and bool(NAME_BEFORE.search(left)), word in _STUDY_ENDS and bool(NOT_NAME_BEFORE.search(left))


def _runs(text: str, taken: list[tuple[int, int]]) -> Iterator[list[tuple]]:
    """The capitalised tokens of each run, (start, end, word); a run ends where a taken span begins and goes on after it."""
    for run in RUN.finditer(text):
        a0, b0 = run.span()
        if " " in run[0] or "\xa0" in run[0]:
            tokens = [(m.start() + a0, m.end() + a0, m[0]) for m in TOKEN.finditer(run[0])]
        else:
            tokens = [(a0, b0, run[0])]
        near = [(a, b) for a, b in taken if a < b0 and a0 < b] if taken else taken
        if not near:
            yield tokens
            continue
        part: list[tuple] = []
        for t in tokens:
            if any(a < t[1] and t[0] < b for a, b in near):
                if part:
                    yield part
                part = []
            else:
                part.append(t)
        if part:
            yield part


def _candidate(text: str, part: list[tuple], comma: bool, given: frozenset[str], common: frozenset[str], starts: frozenset[int]) -> Iterator[tuple]:
    a, b = part[0][0], part[-1][1]
    value, right = text[a:b], text[b : b + 40].replace("\n", " ")
    known = any(p[2].casefold() in given for p in part)
    words = [p[2] for p in part if len(p[2].rstrip(".")) > 1]
    title, before, study = _cues(text, a)
    after = bool(NAME_AFTER.match(right))
    # The number of a house or the name in an email is no number of a study.
    apart = next((i for i in range(4) if b + i in starts), len(right))
    against = bool(NOT_NAME_AFTER.match(right[:apart]) or (study and not title))
    pair = len(words) > 1 and (comma or known or any(w.isupper() for w in words) != all(w.isupper() for w in words) or len(part) > len(words))
    # Several words that are not ordinary, written as names are.
    form = (len(words) > 1 or len(part) > len(words) > 0) and all(len(w) > 2 for w in words)
    if not (known or title or before or after or pair or len(words) > 1):
        return
    if re.match(r"[-–]\d|\d", right):
        return
    w1, w2 = _around(text, a, b)[2:]
    plain = any(w.casefold() in common and w.casefold() not in given for w in words)
    votes = [1 if known else -1, 1 if title else -1, 1 if before else -1, 1 if after else -1, 1 if pair or len(part) > len(words) else 0 if len(words) == 1 and not title else -1, 0 if against else -1, 0 if plain else -1, 1 if form and not plain else -1]
    tail = next((w for w in reversed(words) if w.casefold() not in given), words[-1]).casefold()
    yield a, b, value, votes, (tail[:3], tail[-3:], tail[-4:], known, len(part)), w1, w2


def _names(text: str, given: frozenset[str], common: frozenset[str], often: frozenset[str], taken: list[tuple[int, int]], starts: frozenset[int]) -> Iterator[tuple]:
    """Candidate names: (start, end, votes, extra features). Common words and words that are often capitalised are parts of
    names only beside a title, a cue or a given name; then the name is a candidate with them and without them. taken: spans that no
    name may hold; starts: where emails and addresses begin."""
    for tokens in _runs(text, taken):
        at = 0
        while at < len(tokens):
            low = tokens[at][2].casefold().rstrip(".")
            ordinary = (low in common or low in often) and low not in given and len(tokens[at][2].rstrip(".")) > 1
            follows = tokens[at + 1][2] if at + 1 < len(tokens) else ""
            turned = bool(follows) and "," in text[tokens[at][1] : tokens[at + 1][0]] and follows.casefold() in given
            if (low in _TITLES and not re.fullmatch(r"[A-ZÀ-Þ]\.", tokens[at][2])) or (ordinary and not turned and not any(_cues(text, tokens[at][0])[:2])):
                at += 1
                continue
            # As many tokens as a name may have: initials, given names, one family name, or family name, given names.
            part = [tokens[at]]
            comma = False
            more = longer = None
            families = int(low not in given and len(low) > 1)
            for i in range(at + 1, len(tokens)):
                nxt = tokens[i]
                between, word = text[part[-1][1] : nxt[0]], nxt[2].casefold().rstrip(".")
                if word in _TITLES:
                    break
                if between.strip(" \xa0,"):  # a particle
                    longer = i
                    break
                if (word in common or word in often) and word not in given and len(word) > 1:
                    known = part[0][2].casefold() in given or len(part[0][2]) == 2
                    if "," not in between and not comma and not ordinary and families < 2 - known and (known or any(_cues(text, part[0][0])[:2]) or (word not in common and NAME_AFTER.match(text[nxt[1] : nxt[1] + 40]))):
                        more = nxt
                    break
                if "," in between:
                    if comma or len(part) != 1 or not families:
                        break
                    comma = True
                elif comma and len(word) > 1 and word not in given and len(part) > 1:
                    break
                elif len(word) > 1 and word not in given and families and not comma:
                    # A second family-like token: the first may be an unknown given name, a third is none.
                    if sum(len(p[2].rstrip(".")) > 1 for p in part) >= 2 or part[0][2].casefold() in given or len(part[0][2]) == 2:
                        longer = i
                        break
                if len(word) > 1 and word not in given:
                    families += 1
                part.append(nxt)
            if more:
                yield from _candidate(text, [*part, more], False, given, common, starts)
            while part and re.fullmatch(r"[A-ZÀ-Þ]\.", part[-1][2]) and not comma:
                part.pop()
            if not part:
                at += 1
                continue
            # What follows an ordinary word may be a name without it.
            at += 1 if ordinary else len(part)
            yield from _candidate(text, part, comma, given, common, starts)
            if longer and not comma and not ordinary and _INSIDE.search(text[max(0, part[0][0] - 24) : part[0][0]]):
                # Further family names, with their particles, as far as words go that are not ordinary.
                end = longer
                while end < len(tokens) and "," not in text[tokens[end - 1][1] : tokens[end][0]] and len(w := tokens[end][2].casefold().rstrip(".")) > 1 and w not in common and w not in often and w not in _TITLES and w not in _CUE_WORDS:
                    end += 1
                if end > longer:
                    yield from _candidate(text, [*part, *tokens[longer:end]], False, given, common, starts)


def candidates(text: str, given: frozenset[str], common: frozenset[str], often: frozenset[str] = frozenset()) -> list[tuple]:
    """(start, end, type, value, votes, features, cluster) of each candidate; candidates of a cluster exclude each other."""
    out = []
    taken: list[tuple[int, int]] = []
    for m in EMAIL.finditer(text) if _AT_SIGN.search(text) else ():
        left, right, w1, w2 = _around(text, m.start(), m.end())
        plain = bool(re.search("[@＠]", m[0]))
        votes = [1 if plain else -1, 1 if re.search(r"\(at\)|\[at\]|\{at\}|\[dot\]|\(dot\)", m[0], re.I) or not re.search(r"\s", m[0]) else -1, 1 if re.search(r"[\w)\]]\.?[a-z]{2,}$", m[0]) else 0]
        out.append((m.start(), m.end(), "email", m[0], votes, _features("email", m[0], w1, w2, (), votes)))
        taken.append((m.start(), m.end()))
    free = lambda a, b: not any(x < b and a < y for x, y in taken)
    spans: list[tuple[int, int]] = []
    for i, p in enumerate(ADDRESS):
        for m in p.finditer(text) if (_POSTCODE if i else _FIGURE).search(text) else ():
            if free(m.start(), m.end()) and not any(x < m.end() and m.start() < y for x, y in spans):
                left, right, w1, w2 = _around(text, m.start(), m.end())
                votes = [1, 1 if ADDRESS_BEFORE.search(left) else -1, 1 if re.search(_POST, m[0]) else -1, 1 if i or re.search(_KIND, m[0]) else 0]
                out.append((m.start(), m.end(), "address", m[0], votes, _features("address", m[0], w1, w2, (i,), votes)))
                spans.append((m.start(), m.end()))
    taken += spans
    starts = frozenset(a for a, _ in taken)
    digits = bool(_DIGITS.search(text))
    for m in PHONE.finditer(text) if digits else ():
        n = sum(c.isdigit() for c in m[0])
        if 8 <= n <= 15 and free(m.start(), m.end()):
            left, right, w1, w2 = _around(text, m.start(), m.end())
            cue, id_cue, no = PHONE_BEFORE.search(left), ID_BEFORE.search(left), NOT_PERSON_BEFORE.search(left)
            votes = [1 if PHONE_SHAPE.match(m[0]) else 0, 1 if cue else -1, 1 if PHONE_AFTER.match(right) else -1, 0 if no or id_cue else -1, 0 if ID_SHAPE.match(m[0]) else -1]
            out.append((m.start(), m.end(), "phone", m[0], votes, _features("phone", m[0], w1, w2, (n,), votes)))
    for m in ID.finditer(text) if digits else ():
        if free(m.start(), m.end()):
            value, a = m[0], m.start()
            label = re.match(r"(?:MRN|SSN|NHS|ID|NO|NR)[ -]", value)
            if label:
                value, a = value[label.end() :], a + label.end()
            # The letter of a number must not be the first of the next sentence.
            tail = re.search(r" [A-Z]$", value)
            if tail and not re.match(r"[A-Z]{2} ?\d\d ?\d\d ?\d\d [A-D]$", value):
                value = value[: tail.start()]
            b = a + len(value)
            n = sum(c.isdigit() for c in value)
            left, right, w1, w2 = _around(text, a, b)
            cue, no = ID_BEFORE.search(left) or label, NOT_PERSON_BEFORE.search(left)
            votes = [1 if ID_SHAPE.match(value) else -1, 1 if cue else -1, 1 if ID_AFTER.match(right) else -1, 0 if no else -1, 0 if PHONE_BEFORE.search(left) and not cue else -1]
            out.append((a, b, "id_number", value, votes, _features("id_number", value, w1, w2, (n,), votes)))
    numbers = [(x[0], x[1]) for x in out]
    for a, b, value, votes, extra, w1, w2 in _names(text, given, common, often, numbers, starts):
        out.append((a, b, "name", value, votes, _features("name", value, w1, w2, extra, votes)))
    out.sort(key=lambda x: (x[0], x[1]))
    cluster, end, marked = -1, -1, []
    for x in out:
        cluster, end = (cluster, max(end, x[1])) if x[0] < end else (cluster + 1, x[1])
        marked.append((*x, cluster))
    return marked


def _better(score: float, value: str, best: tuple) -> bool:
    """Surer, or about as sure and longer."""
    return (round(score, 2), len(value)) > (round(best[4], 2), len(best[3]))


class Model:
    """What decides: the gazetteer, the common words and those that are often capitalised, and a classifier a type."""

    def __init__(self, given: frozenset[str], common: frozenset[str], often: frozenset[str] = frozenset()):
        self.given, self.common, self.often = given, common, often
        self.labels: dict[str, tuple[float, np.ndarray]] = {}
        self.classifiers: dict[str, Ngrams] = {}

    def belief(self, kind: str, votes: np.ndarray) -> np.ndarray:
        """Posteriors of the label model."""
        post = posterior(votes, *self.labels[kind])
        # Emails and addresses have patterns that little else fits.
        post = np.where((votes == 1).any(axis=1), post, 0.0)
        return np.where(votes[:, VETO[kind]] == 0, 0.0, post) if kind in VETO else post

    def scores(self, kinds: list[str], feats: np.ndarray, votes: list) -> np.ndarray:
        p = np.zeros(len(kinds))
        kinds_ = np.array(kinds, dtype=object)
        for t in self.labels:
            at = np.flatnonzero(kinds_ == t)
            if len(at):
                p[at] = self.classifiers[t].score(feats[at]) if t in self.classifiers else self.belief(t, np.array([votes[i] for i in at]))
        return p

    def spans(self, text: str) -> list[tuple[int, int, str, str, float]]:
        """(start, end, type, value, score) of what is found, without overlaps."""
        found = candidates(text, self.given, self.common, self.often)
        if not found:
            return []
        p = self.scores([c[2] for c in found], np.array([c[5] for c in found]), [c[4] for c in found])
        best: dict[int, tuple] = {}
        for c, s in zip(found, p):
            if s > 0.5 and (c[6] not in best or _better(s, c[3], best[c[6]])):
                best[c[6]] = (c[0], c[1], c[2], c[3], float(s))
        return list(best.values())

    def redact(self, text: str) -> tuple[str, int]:
        """The text with placeholders, and how many."""
        out, at, found = [], 0, sorted(self.spans(text))
        for a, b, kind, _, _ in found:
            out += [text[at:a], PLACEHOLDERS[kind]]
            at = b
        return "".join(out) + text[at:], len(found)


def common_words(texts: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Words that many texts write in lower case, and other words that many texts write otherwise, folded: surely more than
    COMMON of all, at any number of texts. Texts of the same words, however often they repeat, are one text; an email has no words, as
    they may be names."""
    mail = F.lit(False)
    for sign in ("@", "＠", "(at", "[at", "{at", " dot "):
        mail = mail | F.lower("t").contains(sign)
    text = F.when(mail, F.regexp_replace("t", _EMAIL_LIKE, " ")).otherwise(F.col("t"))
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{L}{2,}"), F.lit(0))))
    each = cut(texts.select(words.alias("w")).groupBy(F.xxhash64("w")).agg(F.first("w").alias("w")).select("w"))
    mean = each.count() * COMMON
    least = mean + 3 * mean**0.5 + 3
    seen = [r[0] for r in each.select(F.explode("w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("w").collect()]
    common = frozenset(w for w in seen if w == w.lower())
    return common, frozenset(w.casefold() for w in seen) - common


def shares(counts: dict[str, int], sample: int) -> dict[str, float]:
    """The part of each type that is drawn: all of a type with fewer than its equal share, whose rest goes to the others."""
    out: dict[str, float] = {}
    for i, (t, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        own = min(n, sample // (len(counts) - i))
        sample -= own
        out[t] = own / n
    return out


def learn(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, found_too: bool = True) -> tuple[Model, DataFrame]:
    """The model, and the scored candidates of all documents (key, start, cluster, pii_type, pii_value, score).

    Word counts, candidates and vote patterns are of all documents and whole texts. The common words are at most
    1 / COMMON times the mean number of words of a document, the patterns at most 3 ** 8 a type; the classifier is trained
    on about `sample` candidates, and a type of which few are drawn is decided by the label model. Null and empty texts have no candidates; without any given name, context and form decide.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    column = "given_name" if "given_name" in names.columns else names.columns[0]
    listed = names.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_NAMES + 1).collect()
    if len(listed) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} given names: too many to send to every task")
    given = frozenset(r[0].strip().casefold() for r in listed)
    have = docs.where(F.length(text) > 0).select(key, text)
    common, often = common_words(have.select(F.col(text).alias("t")))
    model = Model(given, common | frozenset(w for ws in FUNCTION_WORDS.values() for w in ws.split()) | SENTENCE_WORDS, often)
    start = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = start.value
        for batch in batches:
            rows = [(k, *c) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in candidates(t, m.given, m.common, m.often)]
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.list_(pa.int8())), pa.array(cols[6], pa.list_(pa.int32())), pa.array(cols[7], pa.int32())],
                names=[key, "start", "pii_type", "pii_value", "votes", "feats", "cluster"],
            )

    found = cut(have.mapInArrow(run, f"`{key}` {kind}, start int, pii_type string, pii_value string, votes array<tinyint>, feats array<int>, cluster int"))
    seen: dict[str, list] = {}
    for r in found.groupBy("pii_type", "votes").agg(F.count(F.lit(1)).alias("n")).collect():
        seen.setdefault(r["pii_type"], []).append((list(r["votes"]), r["n"]))
    soft: dict[tuple, float] = {}
    for t, x in seen.items():
        p, c = np.array([v for v, _ in x]), np.array([k for _, k in x], float)
        model.labels[t] = fit(p, c, prior=PRIOR[t], most=0.98)
        soft |= {(t, tuple(v)): float(y) for v, y in zip(p.tolist(), model.belief(t, p))}
    share = shares({t: sum(k for _, k in x) for t, x in seen.items()}, sample)
    part = F.create_map(*[F.lit(v) for t, y in share.items() for v in (t, int(1_000_003 * y))])[F.col("pii_type")] if share else F.lit(0)
    draw = found.where(F.pmod(F.xxhash64(key, "start", "pii_type"), F.lit(1_000_003)) < part).select("pii_type", "votes", "feats").limit(2 * sample).collect()
    for t in seen:
        own = [(r["feats"], soft[(t, tuple(r["votes"]))]) for r in draw if r["pii_type"] == t]
        if len(own) >= FEW:
            model.classifiers[t] = Ngrams().fit(np.array([f for f, _ in own]), np.array([y for _, y in own]), rounds=int(np.clip(8000 // len(own), 4, 200)))
    if not found_too:
        return model, found
    ready = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(kinds: pd.Series, feats: pd.Series, votes: pd.Series) -> pd.Series:
        return pd.Series(ready.value.scores(list(kinds), np.array(feats.tolist(), dtype=np.int64).reshape(len(kinds), -1), list(votes)))

    return model, found.withColumn("score", score("pii_type", "feats", "votes"))


def personal_information(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pii_type, pii_value, n: what each document holds and how often; of spans that overlap the surest one, or the longest of those
    that are about as sure."""
    _, scored = learn(docs, names, key, text)
    sure = scored.where("score > 0.5").groupBy(key, "cluster").agg(F.max_by(F.struct("pii_type", "pii_value"), F.struct(F.round("score", 2), F.length("pii_value"), -F.col("start"))).alias("x"))
    return sure.groupBy(key, "x.pii_type", "x.pii_value").agg(F.count(F.lit(1)).alias("n"))


def redacted(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text with typed placeholders in place of what is found, n_spans. Null stays null, empty stays empty."""
    model, _ = learn(docs, names, key, text, found_too=False)
    ready = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [ready.value.redact(t) if t else (t, 0) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], names=[key, "text", "n_spans"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, text string, n_spans int")
