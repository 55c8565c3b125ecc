"""An independent set of written-out rules for the defects, against which the classifier is held."""

from __future__ import annotations

import re

from driftloom.llm.defects import _FENCED, _leaves, asked_language, is_copy, is_empty, without_echo
from driftloom.llm.endings import cut_kind, is_cut, strip
from driftloom.llm.languages import language_of

_DO_EN = r"(?:help|assist|answer|describ\w*|writ\w+|review\w*|judg\w*|comment\w*|produc\w*|document\w*|provid\w*|complet\w*|discuss\w*|generat\w*|fulfil\w*|respond\w*|compl(?:y|ies)|continu\w*|translat\w*|explain\w*|do (?:this|that|so)|support|share|verify|check this|process this|perform)"
_REFUSALS = [
    re.compile(p, re.I)
    for p in (
        rf"\bI(?:'m| am)?\b[^.;]{{0,40}}\b(?:can(?:no|')t|can not|cannot|won(?:')?t|will not|unable to|not able to|be able to|not permitted to|not allowed to|rather not|decline to|refuse to|must decline|have to decline|pass on)\b.{{0,40}}?\b{_DO_EN}",
        r"\bI\b[^.]{0,30}\b(?:must|have to|will have to|need to) (?:decline|refuse|pass on)\b",
        r"\b(?:my|our|the) (?:polic(?:y|ies)|guidelines?|rules?|instructions?) (?:do(?:es)? not|don't|doesn't|forbids?|prohibits?|prevents?)\b.{0,20}\b(?:permit|allow|let|answer\w*|me|us)\b",
        r"\b(?:request|question|task) (?:goes|is) against (?:my|our) (?:guidelines?|polic(?:y|ies)|rules?)\b",
        r"^(?:sorry|apologies)\W+no\b",
        r"\bno (?:documentation|answer|text) will be (?:produced|given|written)\b",
        # German
        r"\b(?:kann|darf|werde|möchte|will|könnte)\b(?=.*\bich\b).{0,80}\bnicht(?:s)?\b.{0,80}\b(?:helfen|beantworten|schreiben|beurteilen|beschreiben|prüfen|weiterhelfen|dokumentieren|liefern|erfüllen|bearbeiten|kommentieren|erklären|bewerten|übersetzen|erstellen|sagen)\b",
        r"\bich\b.{0,30}\bmuss\b.{0,80}\b(?:ablehnen|verweigern)\b|\bmuss ich\b.{0,80}\b(?:ablehnen|verweigern)\b|\bich lehne\b.{0,80}\bab\b",
        r"\bbin ich nicht in der Lage\b|\bich bin nicht in der Lage\b|\bist mir nicht (?:erlaubt|gestattet)\b",
        # Russian
        r"(?:я\b.{0,30}\b|\bмне\b.{0,10}|^[^.]{0,40})(?:не (?:могу|стану|буду)|нельзя)\b.{0,40}\b(?:помочь|писать|оценивать|описывать|описать|проверить|проверять|ответить|отвечать|написать|выполнить|комментировать|объяснить|оценить|переводить)\b",
        r"вынужден\w* отказаться|отказываюсь|не позволя\w+ мне",
    )
]
_REFERRALS = re.compile(
    r"^(?:you (?:could|can|may|might|should)\b|please\b|bitte\b|try\b|feel free\b|if you\b|let me know|sorry\b|apologies\b|thank|es tut mir leid|leider\b|entschuldig"
    r"|обратитесь|попробуйте|пожалуйста|спросите|извините|к сожалению|спасибо|вы можете|wende dich|wenden sie|du kannst|sie können|frag)",
    re.I,
)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def declines(sentence: str) -> bool:
    return any(p.search(sentence) for p in _REFUSALS)


def is_refusal(text: str | None) -> bool:
    """Declines the task in every sentence that is not a referral elsewhere, so that no answer is left."""
    if text is None:
        return False
    t = strip(text)
    m = _FENCED.match(t)
    if m:
        t = strip(m.group(1))
    if t[:1] in "{[":
        try:
            t = " ".join(s for s in _leaves(t) if isinstance(s, str))
        except ValueError:
            return False
    declined = False
    for s in _SENTENCE.split(strip(t).strip("\"'")):
        if s.strip():
            if declines(s):
                declined = True
            elif not _REFERRALS.match(s.strip("\"'> ")):
                return False
    return declined


def defect_of(system: str | None, user: str | None, response: str | None, at_limit: bool = False) -> str | None:
    """The first defect of the fixed order that the pair has, or None; at a field limit, endings that style alone excuses are cut."""
    if is_empty(response):
        return "empty"
    if is_refusal(response):
        return "refusal"
    if is_copy(user, response):
        return "copy"
    if is_cut(response) or at_limit and cut_kind(response):
        return "truncated"
    asked, given = asked_language(system, user), language_of(without_echo(user, response))
    return "other_language" if asked and given and asked != given else None
