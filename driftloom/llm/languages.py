"""Which of the corpus languages a text is written in, and which one a message asks for."""

from __future__ import annotations

import re

#: Frequent function words of the languages of Latin script, fixed values.
WORDS = {
    "en": "the of and to in is that it for as with be by on not this are or from at which when if an was but its must may between before after through into than then only how what why does role you your please explain describe write work together called without check against who where",
    "de": "der die das und ist nicht ein eine einer einem einen den dem des zu mit von für auf als auch sich im in wenn wird werden durch über nach bei oder aus vor ohne nur bis da weil sofern damit was wie warum welche muss müssen bitte beschreibe erkläre am zum zur pro noch keine kein ich diese dieses dabei leider",
    "fr": "le la les des et est une un dans pour que qui sur avec pas par plus ce cette ces sont aux au du ou mais comme je vous il elle nous leur être sans entre après avant lorsque peut doit quand désolé ne",
    "es": "el la los las de y en que es una un por con para del se no su al lo como más pero sus le este esta estos son entre cuando sin sobre también fue muy puede debe hay ser yo usted siento",
    "it": "il lo la gli le di e che è un una per con non si del della dei delle nel nella sono come più ma anche questo questa quando senza tra fra può deve essere io voi dispiace al alla",
    "pt": "o os as de e que em um uma para com não por do da dos das no na nos nas é se mais como mas ao aos pelo pela são quando sem entre também ser pode deve eu você este esta isso",
    "nl": "de het een en van is dat op te zijn met voor niet aan er om ook als bij door maar of uit naar dan wordt worden over tot zonder tussen na wanneer kan moet ik u deze dit geen",
    "pl": "i w na z do nie się to jest że o jak po co ale od przez przy dla oraz lub gdy bez między który która które są może musi być ten ta te tego",
}
_ENGLISH = frozenset(WORDS["en"].split()) | frozenset("no do me so we he a i you per".split())
#: Word to languages; what English shares with languages other than German speaks for English alone.
_SPEAKS: dict[str, list[str]] = {}
for _k, _v in WORDS.items():
    for _w in _v.split():
        if _k in ("en", "de") or _w not in _ENGLISH:
            _SPEAKS.setdefault(_w, []).append(_k)
#: Letters that speak for one of them, fixed values.
_LETTERS = {"de": frozenset("äöüß"), "fr": frozenset("çœêèàù"), "es": frozenset("ñ¿¡"), "pt": frozenset("ãõ"), "pl": frozenset("łżźśćęą")}
#: Scripts by the code points of their letters; Cyrillic is Russian unless it has letters of Ukrainian.  Fixed values.
_SCRIPTS = {
    "ru": r"\u0400-\u04ff", "el": r"\u0370-\u03ff", "he": r"\u0590-\u05ff", "ar": r"\u0600-\u06ff", "hi": r"\u0900-\u097f", "th": r"\u0e00-\u0e7f", "ja": r"\u3040-\u30ff", "ko": r"\uac00-\ud7af",
    "zh": r"\u4e00-\u9fff",
}
_SCRIPT = {k: re.compile(f"[{v}]+") for k, v in _SCRIPTS.items()}
_OTHER = re.compile("[" + "".join(_SCRIPTS.values()) + "]+")
_UKRAINIAN = re.compile("[іїєґ]", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_WHOLE_FENCE = re.compile(r"^\s*```\w*\s*\n(\s*[{\[].*?)\n?\s*```\s*$", re.S)
_SPAN = re.compile(r"`[^`\n]*`?")
_JSON_KEY = re.compile(r'"[\w:/.#\-]*"\s*:')
_IDENT = re.compile(r"\b\w*[a-z\d][A-Z]\w*\b|\b\w+(?:[/#_.\\]\w+)+\b")
_JSON_REFS = re.compile(r'"(?:informativeness|novelty|specificity)"\s*:\s*[\d.]+')
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]+")

#: How the languages are named, fixed values.
NAMES = {
    "en": r"english|englisch\w*|английск\w*|anglais|inglés|inglese|inglês",
    "de": r"german|deutsch\w*|немецк\w*|allemand|alemán|tedesco|alemão",
    "ru": r"russian|russisch\w*|русск\w*|russe|ruso",
    "fr": r"french|französisch\w*|французск\w*|français|francés|francese|francês",
    "es": r"spanish|spanisch\w*|испанск\w*|espagnol|español|spagnolo|espanhol",
    "it": r"italian|italienisch\w*|итальянск\w*|italien|italiano",
    "pt": r"portuguese|portugiesisch\w*|португальск\w*|portugais|portugués|português",
    "nl": r"dutch|niederländisch\w*|нидерландск\w*|néerlandais|nederlands",
    "pl": r"polish|polnisch\w*|польск\w*|polonais|polski\w*",
    "uk": r"ukrainian|ukrainisch\w*|украинск\w*|українськ\w*",
    "zh": r"chinese|chinesisch\w*|китайск\w*|chinois|中文",
    "ja": r"japanese|japanisch\w*|японск\w*|japonais|日本語",
}
_NAMED = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)", re.I) for k, v in NAMES.items()}
_STEMS = [x.replace("\\w*", "") for v in NAMES.values() for x in v.split("|")]
_TAGS = "|".join(NAMES)
_CODE = re.compile(rf"(?:language|sprache|язык\w*)\s*[:=]\s*[\"']?({_TAGS})(?!\w)|(?:(?<!\w)(?:answer|reply|write|respond|antworte|antworten|schreibe|ответь|отвечай|пиши)\s+(?:in|auf|на)\s+[\"']?({_TAGS}))(?!\w)|(?:(?<!\w)(?:in|auf|на))\s+[\"']?(en|de|ru)(?!\w)", re.I)


def prose(text: str) -> str:
    """The text without code fences, code spans, JSON keys and identifiers."""
    whole = _WHOLE_FENCE.match(text)
    if whole:
        text = whole.group(1)
    t = _SPAN.sub(" ", _FENCE.sub(" ", text))
    if t.lstrip()[:1] in "{[":
        t = _JSON_KEY.sub(" ", _JSON_REFS.sub(" ", t))
    return _IDENT.sub(" ", t)


def language_of(text: str | None) -> str | None:
    """The language of a text by its script and function words, or None where too little prose is left to tell."""
    if not text:
        return None
    t = prose(text)
    lat, other = (sum(map(len, p.findall(t))) for p in (_LATIN, _OTHER))
    if lat + other < 4:
        return None
    if other > lat:
        n = {k: sum(map(len, p.findall(t))) for k, p in _SCRIPT.items()}
        best = "ja" if n["ja"] and n["ja"] * 4 > n["zh"] else max(n, key=n.get)
        return "uk" if best == "ru" and len(_UKRAINIAN.findall(t)) * 50 > n["ru"] else best
    n = dict.fromkeys(WORDS, 0)
    for w in _WORD.findall(t.lower()):
        for k in _SPEAKS.get(w, ()):
            n[k] += 1
        if not w.isascii():
            for k, letters in _LETTERS.items():
                n[k] += not letters.isdisjoint(w)
    first, second = sorted(n, key=n.get, reverse=True)[:2]
    return None if n[first] == n[second] else first


def language_named(text: str | None) -> str | None:
    """The language a message names, outside code; the last one where it names several."""
    if not text:
        return None
    t = _SPAN.sub(" ", _FENCE.sub(" ", text))
    last, at = None, -1
    low = t.lower()
    for k, p in _NAMED.items() if any(x in low for x in _STEMS) else ():
        for m in p.finditer(t):
            if m.start() > at:
                last, at = k, m.start()
    for m in _CODE.finditer(t):
        if m.start() > at:
            last, at = next(filter(None, m.groups())).lower(), m.start()
    return last
