"""Refusals composed for training: openers, ways to decline, tasks, reasons and referrals of eight languages.

Every fourth way to decline is kept out of the fitted set and used to set the threshold, so that the threshold is
chosen on wordings the model has not seen.
"""

from __future__ import annotations

import random

#: (openers, ways to decline with {} for the task, tasks, reasons, sentences that decline by themselves, referrals)
PARTS: dict[str, tuple[list[str], list[str], list[str], list[str], list[str], list[str]]] = {
    "en": (
        ["", "", "I'm sorry, but ", "Sorry, ", "Unfortunately, ", "Unfortunately ", "Apologies, ", "I apologise, but ", "I'm afraid ", "Thank you for the question, but ", "Thanks for the details, yet ", "Having read your message, ", "As an AI model, ", "Regrettably, "],
        ["I can't {}", "I cannot {}", "I am unable to {}", "I'm not able to {}", "I won't {}", "I will not {}", "I won't be able to {}", "I'm not allowed to {}", "I am not permitted to {}", "I must decline to {}", "I have to decline to {}", "I have to refuse to {}", "I would rather not {}", "I'd prefer not to {}", "I will have to pass on the request to {}", "I need to pass on the task to {}", "I do not feel comfortable to {}", "it is not possible for me to {}", "I refuse to {}", "I decline to {}", "I am not in a position to {}", "I have no permission to {}", "I may not {}", "I don't want to {}"],
        ["help with this", "help with that request", "assist here", "answer this", "answer the question", "describe {x}", "document {x}", "write about {x}", "write this text", "review the file", "review {x}", "comment on the code", "comment on {x}", "produce this block", "provide that information", "complete the task", "judge {x}", "discuss internal code", "explain {x}", "check {x}", "translate this", "do this", "do that", "continue"],
        ["", "", "", " under my guidelines", " under the current rules", " because it may reveal private data", " as it could expose protected material", ", as my policy forbids it", "; it is outside my scope", ", which is not part of my task", " without permission from the owner", " for safety reasons", "; that falls outside what I may do"],
        ["Sorry, no.", "No, I will not do that.", "I refuse.", "I must decline.", "I have to decline this request.", "I'd rather not.", "This request goes against my guidelines.", "The task is against our policy.", "My policy does not allow me to answer.", "My rules don't permit it.", "Our guidelines forbid this.", "My instructions prevent me from answering.", "That is not something I can help with.", "This is not something I am able to do.", "I am not comfortable with this request.", "This lies outside my remit.", "The question is beyond what I may discuss.", "Request denied.", "I can't do that.", "I cannot help.", "That would be against the rules, so I will not write anything.", "Nothing can be written about this here.", "No answer can be given to this request.", "There will be no reply to this question."],
        ["Please ask the maintainers.", "Please contact the owner instead.", "You could ask your team.", "Try again with different input.", "Feel free to rephrase the question.", "Let me know if there is something else.", "Ask a colleague instead.", "Perhaps someone else can help."],
    ),
    "de": (
        ["", "", "Leider ", "Tut mir leid, aber ", "Es tut mir leid, ", "Entschuldigung, ", "Nach Durchsicht der Anfrage ", "Als KI-Modell ", "Bedauerlicherweise "],
        ["kann ich {} nicht {v}", "darf ich {} nicht {v}", "werde ich {} nicht {v}", "möchte ich {} nicht {v}", "ich kann {} nicht {v}", "ich darf {} nicht {v}", "ich werde {} nicht {v}", "ich will {} nicht {v}", "ist es mir nicht möglich, {} zu {v}", "bin ich nicht befugt, {} zu {v}", "bin ich nicht in der Lage, {} zu {v}", "ist mir nicht gestattet, {} zu {v}", "sehe ich mich außerstande, {} zu {v}", "muss ich es ablehnen, {} zu {v}", "weigere ich mich, {} zu {v}", "kann ich hierzu nichts {v}", "darf ich dazu nichts {v}"],
        ["{x}", "diese Datei", "den Code", "diese Frage", "den Abschnitt", "das", "die Anfrage", "diesen Text"],
        ["", "", ", weil es den Regeln widerspricht", ", da es gegen meine Vorgaben verstößt", ", weil es nicht zu meinen Aufgaben gehört", " ohne Erlaubnis", ", da die Richtlinien das verbieten"],
        ["Das muss ich ablehnen.", "Ich lehne das ab.", "Ich muss die Anfrage ablehnen.", "Dabei kann ich nicht helfen.", "Damit kann ich leider nicht dienen.", "Meine Richtlinien erlauben das nicht.", "Das verstößt gegen meine Regeln.", "Das gehört nicht zu meinen Aufgaben.", "Die Bitte um die Prüfung muss ich ablehnen.", "Ich muss die Bearbeitung verweigern.", "Nein, das mache ich nicht.", "Darüber darf ich keine Auskunft geben."],
        ["Bitte frage das Team.", "Bitte wende dich an die Betreuer.", "Frag besser jemand anderen.", "Du kannst es mit anderen Angaben versuchen."],
    ),
    "ru": (
        ["", "", "К сожалению, ", "Извините, ", "Простите, но ", "Увы, ", "Сожалею, но ", "Как языковая модель, "],
        ["я не могу {}", "мне нельзя {}", "я не стану {}", "я не буду {}", "я не вправе {}", "я вынужден отказаться {}", "мне не разрешено {}", "я отказываюсь {}", "я не в состоянии {}", "мне запрещено {}", "я не имею права {}", "я не готов {}", "у меня нет возможности {}"],
        ["помочь с этим", "ответить на вопрос", "отвечать на это", "описывать {x}", "описывать код", "писать такой текст", "писать этот раздел", "проверять файл", "оценивать {x}", "оценивать этот код", "комментировать {x}", "выполнить запрос", "обсуждать это", "объяснять {x}"],
        ["", "", ", это против правил", ", это запрещено политикой", ", так как это вне моих задач", " без разрешения", ", поскольку это нарушает правила"],
        ["Правила мне этого не позволяют.", "Я вынужден отказаться.", "Я отказываюсь отвечать.", "Это противоречит моим правилам.", "Моя политика этого не разрешает.", "Нет, я не буду этого делать.", "С этим я помочь не могу.", "Это выходит за рамки моих задач.", "Ответа на этот запрос не будет.", "Мне придётся отказать."],
        ["Обратитесь к команде.", "Спросите владельца кода.", "Попробуйте другой запрос.", "Пожалуйста, обратитесь к коллегам."],
    ),
    "fr": (
        ["", "Désolé, ", "Je regrette, mais ", "Malheureusement, ", "Merci, mais "],
        ["je ne peux pas {}", "je ne suis pas en mesure de {}", "je refuse de {}", "je dois refuser de {}", "je ne suis pas autorisé à {}", "il m'est impossible de {}", "je préfère ne pas {}", "je ne vais pas {}"],
        ["vous aider", "répondre à cette question", "décrire {x}", "écrire ce texte", "commenter ce fichier", "faire cela"],
        ["", ", c'est contraire à mes règles", " sans autorisation"],
        ["Je dois décliner cette demande.", "Mes règles ne le permettent pas.", "Non, je ne le ferai pas.", "Cela dépasse mon rôle."],
        ["Veuillez demander à votre équipe.", "Essayez une autre question."],
    ),
    "es": (
        ["", "Lo siento, pero ", "Lamentablemente, ", "Disculpe, ", "Gracias, pero "],
        ["no puedo {}", "no me es posible {}", "no estoy autorizado a {}", "debo negarme a {}", "me niego a {}", "no voy a {}", "prefiero no {}", "no tengo permiso para {}"],
        ["ayudar con esto", "responder a esta pregunta", "describir {x}", "escribir este texto", "comentar el archivo", "hacer eso"],
        ["", ", va contra mis normas", " sin permiso"],
        ["Debo rechazar esta solicitud.", "Mis normas no lo permiten.", "No, no lo haré.", "Eso está fuera de mi alcance."],
        ["Pregunte a su equipo.", "Intente con otra pregunta."],
    ),
    "it": (
        ["", "Mi dispiace, ma ", "Purtroppo ", "Scusa, "],
        ["non posso {}", "non sono in grado di {}", "devo rifiutarmi di {}", "mi rifiuto di {}", "non mi è permesso {}", "preferisco non {}"],
        ["aiutare con questo", "rispondere alla domanda", "descrivere {x}", "scrivere questo testo", "commentare il file"],
        ["", ", è contro le mie regole"],
        ["Devo declinare la richiesta.", "Le mie regole non lo consentono.", "No, non lo farò."],
        ["Chiedi al tuo gruppo."],
    ),
    "pt": (
        ["", "Desculpe, mas ", "Infelizmente, ", "Lamento, mas "],
        ["não posso {}", "não consigo {}", "não estou autorizado a {}", "devo recusar {}", "recuso-me a {}", "prefiro não {}"],
        ["ajudar com isso", "responder a esta pergunta", "descrever {x}", "escrever este texto", "comentar o ficheiro"],
        ["", ", é contra as minhas regras"],
        ["Tenho de recusar este pedido.", "As minhas regras não o permitem.", "Não, não o farei."],
        ["Pergunte à sua equipa."],
    ),
    "nl": (
        ["", "Sorry, maar ", "Helaas ", "Het spijt me, "],
        ["ik kan {} niet", "ik mag {} niet", "ik zal {} niet", "ik weiger {}", "kan ik {} niet", "ik moet weigeren {}"],
        ["hiermee helpen", "deze vraag beantwoorden", "{x} beschrijven", "deze tekst schrijven", "het bestand beoordelen"],
        ["", ", dat is tegen mijn regels"],
        ["Ik moet dit verzoek afwijzen.", "Mijn regels staan dat niet toe.", "Nee, dat doe ik niet."],
        ["Vraag het uw team."],
    ),
}
_VERBS = ["beschreiben", "prüfen", "beantworten", "dokumentieren", "erklären", "schreiben", "beurteilen", "kommentieren", "bearbeiten", "erstellen"]
_MIX = "en en en en de de ru ru fr es it pt nl".split()
_WRAPS = ['{{"error": "{}"}}', '{{"message": "{}"}}', '{{"sections": {{"purpose": "{}"}}}}', "```\n{}\n```", '"{}"', "> {}"]


def _one(rng: random.Random, lang: str, names: list[str], held: bool) -> str:
    openers, ways, tasks, whys, whole, _ = PARTS[lang]
    mine = lambda xs: [x for i, x in enumerate(xs) if (i % 4 == 3) == held] or xs
    if rng.random() < 0.3:
        return rng.choice(mine(whole))
    s = rng.choice(openers) + rng.choice(mine(ways)).replace("{v}", rng.choice(_VERBS)).replace("{}", rng.choice(tasks)) + rng.choice(whys) + "."
    s = s.replace("{x}", rng.choice(names))
    return s[0].upper() + s[1:]


#: Whom and how a refusal refers to: (beginnings, people, second halves).
_REFER = {
    "en": (["You could ask ", "You can contact ", "You may want to ask ", "Please ask ", "Please turn to ", "Try asking ", "I suggest asking "], ["the maintainers", "the owner of the code", "the author", "your team", "the person in charge of this module", "a colleague", "support"], ["", "", " instead", " or try again with different input", " or rephrase the request", " for help", " if you need more"]),
    "de": (["Bitte wende dich an ", "Bitte frage ", "Du kannst dich an ", "Am besten hilft "], ["das Team", "die Betreuer", "den Verfasser", "die zuständige Stelle", "deine Kollegen"], ["", "", " oder versuche es mit anderen Angaben", " weiter"]),
    "ru": (["Обратитесь к ", "Пожалуйста, обратитесь к ", "Попробуйте спросить у ", "Лучше обратиться к "], ["команде", "автора", "коллегам", "хозяину кода", "тем, кто отвечает за модуль"], ["", "", " или измените запрос", " ещё раз"]),
}


def _referral(rng: random.Random, lang: str) -> str:
    if lang not in _REFER or rng.random() < 0.3:
        return rng.choice(PARTS[lang][5])
    begin, who, rest = _REFER[lang]
    return rng.choice(begin) + rng.choice(who) + rng.choice(rest) + "."


#: Statements of fact that deny something without declining anything: (subjects, denials, actions, endings).
_FACTS = {
    "en": (["The parser", "This function", "The guard", "A file", "The caller", "{x}", "This method", "The policy", "A request", "No rule"], ["cannot", "can't", "must not", "may not", "does not", "won't", "is not allowed to", "is unable to", "refuses to", "declines to", "is never asked to"], ["read the file", "be called", "answer the request", "describe the block", "review the entry", "write the text", "help the next step", "reject an input", "run"], ["", " twice", " without a lease", " before the next run", " if the rules forbid it", ", so only the path matters", " and returns nothing"]),
    "de": (["Der Parser", "Diese Funktion", "Die Datei", "Der Aufrufer", "{x}", "Der Schreiber", "Die Regel"], ["kann", "darf", "wird", "muss", "soll"], ["den Text", "die Anfrage", "diesen Abschnitt", "die Datei"], [" nicht zweimal lesen", " nicht ohne Sperre schreiben", " nicht beantworten", " nicht prüfen, wenn die Regeln es verbieten", " ablehnen"]),
    "ru": (["Парсер", "Эта функция", "Файл", "Вызывающий", "{x}", "Запрос", "Правило"], ["не может", "не должен", "не будет", "отказывается", "не вправе"], ["читать файл", "отвечать на запрос", "описывать блок", "писать текст", "проверять раздел"], ["", " дважды", " без блокировки", ", если это против правил", " до следующего шага"]),
    "fr": (["Le lecteur", "Cette fonction", "{x}"], ["ne peut pas", "ne doit pas", "refuse de"], ["lire le fichier", "répondre à la demande"], ["", " deux fois"]),
    "es": (["El lector", "Esta función", "{x}"], ["no puede", "no debe", "se niega a"], ["leer el archivo", "responder a la solicitud"], ["", " dos veces"]),
}


#: Plain statements, so that a language is no sign of a refusal: (subjects, verbs, objects, endings).
_STATEMENTS = {
    "en": (["The parser", "This function", "{x}", "The caller"], ["reads", "checks", "writes", "returns"], ["the file", "the lines", "the next block", "the request"], ["", " before the next run", " and passes it to the caller", " for each member"]),
    "de": (["Der Parser", "Diese Funktion", "{x}", "Der Aufrufer"], ["liest", "prüft", "schreibt", "liefert"], ["die Datei", "die Zeilen", "den nächsten Block", "die Anfrage"], ["", " vor dem nächsten Lauf", " und gibt sie zurück", " ohne den Rest"]),
    "ru": (["Парсер", "Эта функция", "{x}", "Вызывающий"], ["читает", "проверяет", "пишет", "заменяет"], ["файл", "строки", "следующий блок", "запрос"], ["", " перед следующим шагом", " и возвращает его", " без обращения к сети", " вне очереди"]),
    "fr": (["Le lecteur", "Cette fonction", "{x}", "Le module"], ["lit", "vérifie", "écrit", "rend"], ["le fichier", "les lignes", "le bloc suivant", "la demande"], ["", " avant de continuer", " et les rend à la fonction", " pour chaque page"]),
    "es": (["El lector", "Esta función", "{x}", "El módulo"], ["lee", "comprueba", "escribe", "devuelve"], ["el archivo", "las líneas", "el bloque siguiente", "la solicitud"], ["", " antes de seguir", " y lo devuelve", " para cada página"]),
    "it": (["Il lettore", "Questa funzione", "{x}", "Il modulo"], ["legge", "controlla", "scrive", "restituisce"], ["il file", "le righe", "il blocco successivo", "la richiesta"], ["", " prima di continuare", " e lo restituisce"]),
    "pt": (["O leitor", "Esta função", "{x}", "O módulo"], ["lê", "verifica", "escreve", "devolve"], ["o ficheiro", "as linhas", "o bloco seguinte", "o pedido"], ["", " antes de continuar", " e devolve-o"]),
    "nl": (["De lezer", "Deze functie", "{x}", "De module"], ["leest", "controleert", "schrijft", "geeft"], ["het bestand", "de regels", "het volgende blok", "het verzoek"], ["", " voor de volgende stap", " terug aan de aanroeper"]),
}


def fact(rng: random.Random, names: list[str]) -> str:
    """One or two statements about the subject matter, denying or plain; answers, not refusals."""
    said = rng.choice([_FACTS, _STATEMENTS])
    subjects, verbs, objects, ends = said[rng.choice(sorted(said) + ["en", "en"])]
    parts = [" ".join(map(rng.choice, (subjects, verbs, objects))) + rng.choice(ends) + "." for _ in range(rng.choice([1, 1, 2]))]
    return " ".join(parts).replace("{x}", rng.choice(names))


def compose(rng: random.Random, names: list[str], held: bool = False) -> str:
    """A refusal of one to a few sentences, at times much longer, plain or wrapped; `names` are spans it may mention."""
    lang = rng.choice(_MIX)
    n = rng.choice([1, 1, 1, 1, 1, 2, 2, 3, 12])
    parts = [_one(rng, lang, names, held) for _ in range(n)]
    if rng.random() < 0.4:
        parts.append(_referral(rng, lang))
    s = " ".join(parts)
    return rng.choice(_WRAPS).format(s.replace('"', "'")) if rng.random() < 0.25 else s


def sentence(rng: random.Random, names: list[str]) -> str:
    """One refusing sentence, for answers that open with one and answer all the same."""
    return _one(rng, rng.choice(_MIX), names, False)
