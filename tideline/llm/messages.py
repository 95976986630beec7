"""Grammars of messages that programs, servers and viewers print, and of filler text, in several languages.

A message is recognised by its parts, not by its wording: a thing (script, browser, page image, session ...) and what is said of it (is required, was not found,
has expired ...) close together. Each rule names its parts as lists of words; words are written as in print and are folded
and squeezed here like the text they are looked for in: confusable letters are one letter, blanks and hyphens are gone, and sentence marks are full stops.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters a scanner confuses, by the one that stands for them.
ALIKE = {"o": "ec0aéèêëàâäáãóòôöõç", "i": "l1îïíìj", "n": "uüûùúñ", "r": "vyý", "h": "b8", "t": "f", "s": "5", "g": "q"}
CONFUSED = "".join(ALIKE.values())
FOLDED_TO = "".join(a * len(b) for a, b in ALIKE.items())
PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"))
#: Marks that end or divide a sentence, all squeezed to a full stop, and what is left out.
MARKS = ".:!?;,()…"
LEFT_OUT = " \n\r\t ­      ​ 　﻿-‐‑‒–—―¬'\"`´’‘‚“”„«»‹›*_~|/\\<>{}[]=+#%&@$°§•·^"

# --- parts of messages, by what they mean; alternatives are divided by commas

SCRIPTING = "javascript, java script, scripting"
SCRIPTS = "scripts, skripte, cookies, popups"
BROWSER = "browser, navigateur, navegador, viewer, visionneuse, seitenbetrachter, betrachter, visualizador, visualizzatore"
YOUR = "your, ihr, ihre, ihrem, ihren, votre, uw, su, tu, seu, sua, vostro, tuo, your web"
ENABLE = "enable, activate, turn on, turn them on, turn, switch on, allow, allowed, unblock, aktivieren, aktiviere, einschalten, eingeschaltet, erlauben, zulassen, activer, activez, autoriser, autorisez, schakel, inschakelen, ingeschakeld, toestaan, activa, active, activar, habilite, habilita, habilitar, permita, abilita, abilitare, attiva, attivare, ative, ativar, aktivera, aktiver, slå på"
DISABLED = "disabled, turned off, switched off, blocked, deaktiviert, ausgeschaltet, blockiert, désactivés, désactivé, uitgeschakeld, geblokkeerd, desactivado, deshabilitado, disabilitato, disattivato, desativado"
REQUIRED = "require, need, nécessite, requiert, benötigt, erfordert, braucht, muss, nodig, vereist, requiere, necesita, necesario, richiede, necessario, requer, precisa"
UNSUPPORTED = "not supported, not support, unterstützt kein, nicht unterstützt, ne prend pas en charge, pas pris en charge, ondersteunt geen, niet ondersteund, no admite, no es compatible, non supporta, não suporta"
TO_VIEW = "to view, to display, to run this, to use this, to continue, to read this, to access, um diese, um fortzufahren, anzuzeigen, pour afficher, pour voir, pour continuer, om deze, om verder, te bekijken, para ver, para continuar, per visualizzare, per continuare"
RELOAD = "reload the page, reload the viewer, reload the tab, reload this, and reload, then refresh, refresh the page, refresh your, seite neu laden, recharger la page, rechargez la page, pagina vernieuwen, ververs de pagina, recargue la página, ricarica la pagina"
THING = "page, page image, image, file, scan, url, resource, item, document, seite, bild, datei, ressource, dokument, fichier, ressource, ficher, pagina, afbeelding, bestand, document, página, archivo, imagen, file, immagine, documento, ficheiro, imagem"
NOT_FOUND = "not found, nicht gefunden, introuvable, non trouvée, non trouvé, niet gevonden, no encontrada, no encontrado, non trovata, non trovato, não encontrada, não encontrado"
REQUESTED = "requested page, requested image, requested file, requested url, requested scan, requested document, requested resource, page you asked for, page you requested, page you are looking for, page you re looking for, angeforderte, page demandée, ressource demandée, document demandé, opgevraagde, gevraagde pagina, página solicitada, archivo solicitado, pagina richiesta, página solicitada"
MISSING = "not exist, not found, could not, cannot, can t find, couldn t, nicht vorhanden, nicht gefunden, konnte nicht, existiert nicht, n existe pas, introuvable, bestaat niet, kon niet, niet gevonden, no existe, no encontr, non esiste, não existe"
COULD_NOT_BE = "could not be, cannot be, couldn t be, konnte nicht, kann nicht, n a pas pu être, ne peut être, ne peut pas être, kon niet worden, kon niet, kan niet worden, no se pudo, no se puede, non può essere, impossibile, não pôde ser"
SHOWN = "displayed, loaded, shown, rendered, opened, geladen, angezeigt, geöffnet, chargée, chargé, affichée, affiché, weergegeven, getoond, cargar, mostrar, caricata, caricare, visualizzata, carregada, carregar"
GONE = "is no longer available, no longer available in, ist nicht mehr verfügbar, n est plus disponible, is niet langer beschikbaar, ya no está disponible, non è più disponibile"
SERVER_FAULT = "internal server error, interner serverfehler, erreur interne du serveur, interne serverfout, error interno del servidor, errore interno del server, erro interno do servidor, bad gateway, gateway timeout, gateway time out, database connection, datenbankverbindung"
REASON = "not found, forbidden, unauthorized, bad request, internal server, service unavailable, server error, too many requests, request timeout, nicht gefunden, introuvable, niet gevonden, no encontrado, non trovato"
SERVICE_DOWN = "service unavailable, service temporarily unavailable, service momentanément indisponible, service temporairement indisponible, service indisponible, dienst nicht verfügbar, dienst niet beschikbaar, dienst tijdelijk niet beschikbaar, servicio no disponible, servizio non disponibile, server unavailable, website unavailable, archive unavailable"
MAINTENANCE = "maintenance, wartungsarbeiten, onderhoud, mantenimiento, manutenzione, manutenção"
DOWN = "is down for, down for, offline, unavailable, nicht erreichbar, nicht verfügbar, hors ligne, indisponible, niet bereikbaar, niet beschikbaar, no disponible, non disponibile, please try, be back"
TRY_AGAIN = "please try again, try again later, bitte versuchen sie es, versuchen sie es später, später erneut, veuillez réessayer, réessayez plus tard, réessayer plus tard, probeer het later, later opnieuw, inténtelo de nuevo, intente de nuevo, riprova più tardi, riprovare più tardi, tente novamente"
AGAIN_LATER = "later, in a few, in a moment, error, refresh, reload, erneut, später, plus tard, opnieuw, más tarde, più tardi, mais tarde, server, request, sign in, log in"
SESSION = "session, sitzung, sessie, sesión, sessione, sessão"
EXPIRED = "expired, timed out, abgelaufen, expiré, verlopen, caducado, caducada, expirado, expirada, scaduta"
DENIED = "access denied, permission denied, zugriff verweigert, accès refusé, accès interdit, toegang geweigerd, geen toegang, acceso denegado, accesso negato, acesso negado"
ADDRESSED = "you, your, please, contact, log in, sign in, bitte, sie haben, melden sie, vous, veuillez, meld u, meld je, neem contact, usted, por favor, inicie, accedi, non hai, você"
PERMISSION = "not have permission, do not have permission, don t have permission, not authorized to, not authorised to, keine berechtigung, nicht berechtigt, pas les droits, pas l autorisation, pas autorisé, geen rechten, geen toestemming, niet gemachtigd, no tiene permiso, non hai i permessi, não tem permissão"
TO_DO = "to view, to access, to see, to open, this page, this scan, nécessaires, zum anzeigen, zugriff, d accéder, afficher, om deze, te bekijken, para ver, per vedere, para acessar"
LOGIN = "sign in, sign in again, log in, login, anmelden, melden sie sich, loggen sie sich, vous connecter, vous reconnecter, connectez vous, reconnectez vous, meld u aan, meld je aan, inloggen, log in, inicie sesión, iniciar sesión, effettua il login, accedi, faça login, inicie sessão"
ONWARDS = "to view this, to continue, to access this, to see this, um fortzufahren, um diese seite, um diesen scan, pour continuer, pour accéder, pour afficher, om deze scan, om deze pagina, om verder te gaan, para continuar, para ver esta, per continuare, per accedere"
INVALID = "invalid token, expired token, missing token, invalid session, invalid request, invalid credentials, csrf token, ungültiges token, jeton invalide, jeton expiré, ongeldig token, token no válido, token non valido"
TOO_MANY = "too many requests, zu viele anfragen, trop de requêtes, te veel verzoeken, te veel aanvragen, demasiadas solicitudes, troppe richieste"
WAIT = "wait, try, retry, slow, seconds, reload, warten, sekunden, patient, secondes, wacht, seconden, espere, attendi"
WRONG = "something went wrong, etwas ist schiefgelaufen, etwas ist schief gelaufen, une erreur est survenue, une erreur s est produite, er is iets misgegaan, er ging iets mis, algo salió mal, qualcosa è andato storto"
SORRY = "oops, ups, sorry, hoppla, oups, désolé, oeps, vaya, spiacenti"
REPORTED = "our team has been, we have been notified, team has been told, has been notified, please, error, wurde benachrichtigt, nous avons été informés, probeer, reload"
#: What only the output of a program says; a full stop stands where a mark may.
PROGRAM = """
traceback. most recent call, most recent call last, null pointer exception, null pointer error, exception in thread, uncaught exception, uncaught error, uncaught type error, unhandled exception, unhandled rejection,
undefined variable, undefined index, undefined offset, undefined method, undefined function, is not a function at, undefined is not a, cannot read propert, syntax error. unexpected, unexpected token, unexpected end of input, parse error. unexpected,
fatal error. uncaught, fatal error. call, fatal error. allowed, segmentation fault, core dumped, stack overflow error, no such file or directory, module not found, out of memory error, memory exhausted, key error, value error, type error,
index error, name error, attribute error, import error, reference error, runtime error, io exception, sql exception, illegal argument exception, class not found exception, index out of bounds,
connection failed. timeout, connection timed out, connection refused by server, connection reset by peer, could not connect to server, failed to fetch, network error, request failed with status, empty response from, ocr failed, ocr error, ocr engine,
timeout while fetching, timeout after, timed out after, gateway timeout, request id, exit code, http error, ssl error, dns error, query failed
"""
ON_LINE = "on line, auf zeile, à la ligne, op regel"
SAYS_ERROR = "error, fehler, erreur, fout, errore, warning, warnung, notice, variable, in viewer"
ERROR_NUMBER = "error 4, error code 4, fehler 4, fehlercode 4, erreur 4, fout 4, foutcode 4, errore 4, error 500, error 502, error 503, error 504, fehler 500, fehler 503, erreur 500, erreur 503, fout 500, fout 503, errore 500"

# --- parts of filler

GOES_HERE = "headline goes here, title goes here, text goes here, body text goes here, copy goes here, body copy goes here, story goes here, content goes here, caption goes here, image goes here, name goes here, date goes here, article goes here, byline goes here"
HERE = "headline here, title here, text here, story here, überschrift hier, titel hier, text hier, bild hier, titre ici, texte ici, légende ici, kop hier, tekst hier, foto hier, título aquí, texto aquí, titolo qui, testo qui, título aqui, texto aqui"
FOLLOWS = "text to follow, story to follow, copy to follow, headline to follow, caption to follow, text to come, copy to come, text folgt, titel folgt, bild folgt, texte à venir, texte à suivre, titre à venir, photo à venir, tekst volgt, kop volgt, foto volgt, texto por venir, testo a seguire, texto a seguir"
INSERT = "insert story here, insert text here, insert headline here, insert title here, insert name here, insert date here, insert image here, insert photo here, insert caption here, insert article here, insert content here, insert copy here, add text here, type text here, your text here, enter text here, paragraph here, text hier einfügen, insérer le texte ici, insérez votre texte, votre texte ici, ihr text hier, tekst hier invoegen, uw tekst hier, su texto aquí, il tuo testo qui"
THIS_IS = "this is, this is a, this is only, this is just, dies ist ein, das ist ein, hier steht ein, ceci est un, ceci est du, dit is een, dit is, este es un, esto es un, questo è un, este é um"
DUMMY_TEXT = "dummy text, placeholder text, place holder text, filler text, sample text, example text, blindtext, platzhaltertext, platzhalter text, beispieltext, fülltext, mustertext, faux texte, texte factice, texte de remplissage, texte d exemple, voorbeeldtekst, opvultekst, vultekst, plaatshoudertekst, texto de relleno, texto de ejemplo, texto de prueba, testo segnaposto, testo di esempio, testo di prova, texto de exemplo"
FILLS = "fills the column, fill the column, füllt nur die, füllt die spalte, remplir la colonne, kolom vult, vult de kolom, llenar la columna, riempire la colonna, fill this space, fills the space"
PURPOSE = "only, nur, destiné, alleen, until the, solo, sólo, serve, bis der, jusqu, tot het, this text, dieser text, ce texte, deze tekst"
TEST_PAGE = "test page, testseite, page de test, page d essai, testpagina, proefpagina, página de prueba, pagina di prova, página de teste"
NO_PUBLISHING = "do not publish, not for publication, nicht veröffentlichen, ne pas publier, niet publiceren, no publicar, non pubblicare, não publicar, test test, please ignore"
#: Words that fill a space by being set over and over, without a comma between them.
REPEATED = "text texte tekst texto testo test null undefined none nan dummy sample muster mustertext blindtext placeholder platzhalter asdf qwerty blah bla lorem ipsum headline title body copy tbd todo"
# The vocabulary of the usual mock Latin and its generators.
MOCK_LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat
duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vero eos accusam justo duo dolores rebum
stet clita kasd gubergren sea takimata sanctus vel eum hendrerit vulputate molestie feugiat facilisis accumsan odio dignissim blandit praesent luptatum delenit augue eleifend congue nihil imperdiet placerat morbi sem dui ornare
vestibulum ante primis faucibus orci luctus ultrices posuere cubilia curae donec pharetra nunc viverra mauris pellentesque habitant tristique senectus netus malesuada fames ac turpis egestas proin vitae libero cras mi maecenas aenean
massa sociis natoque penatibus magnis dis parturient montes nascetur ridiculus mus felis ultricies nec pretium quam semper fringilla vivamus elementum tincidunt
"""
#: Letters of the words of which a run has at least one.
LONG = 8
#: Short words of living languages and of real Latin: a run of Latin-looking words without any of them is made up.
LIVING = """
that what this his is it at us or for was has not et est sont mais puis depuis dit tout plus nous vous sous tous les des dans dat het niet met wat omdat dit is was hij der dem im am vom zum zur nur aus vor bis mit hat statt wird um
the de la le die una une che que di se me te ne a e o i in il al el per por pro cum ad ab ex non qui quae sed sunt nos deus domine dominus christus pater mater sancta sanctus maria deo dei
"""


def fold(text: str) -> str:
    """The folding of squeezed() and folded texts, for patterns."""
    text = text.lower()
    for a, b in PAIRS:
        text = text.replace(a, b)
    return text.translate(str.maketrans(CONFUSED, FOLDED_TO))


def squeezed(lower: Column) -> Column:
    """A text in lower case, folded, with full stops for sentence marks and without blanks, hyphens and other signs."""
    for a, b in PAIRS:
        lower = F.replace(lower, F.lit(a), F.lit(b))
    return F.translate(lower, CONFUSED + MARKS + LEFT_OUT, FOLDED_TO + "." * len(MARKS))


def listed(text: str) -> list[str]:
    return [w.strip() for w in re.split(r"[,\n]", text) if w.strip()]


def phrase(words: str) -> str:
    """A pattern for words in squeezed text; a full stop after a word stands for a mark that may be there."""
    return r"\.{0,2}".join(squeeze(w) for w in words.split("."))


def any_of(text: str) -> str:
    return "(?:" + "|".join(sorted({phrase(w) for w in listed(text)}, key=lambda p: (-len(p), p))) + ")"


def near(a: str, b: str, gap: int) -> str:
    """Both parts, in either order, with at most ``gap`` letters between them."""
    return rf"{any_of(a)}.{{0,{gap}}}?{any_of(b)}|{any_of(b)}.{{0,{gap}}}?{any_of(a)}"


def then(*parts: str, gap: int = 0) -> str:
    return rf".{{0,{gap}}}?".join(any_of(p) for p in parts)


def rules() -> list[tuple[str, str]]:
    """(anchor, pattern): no pattern matches a text that lacks all words of its anchor."""
    begin, end, number = r"(?:^|\.)", r"(?:\.|$)", "[0-9oishg]"
    written_scripts = "".join(f"(?<!{squeeze(w)})" for w in ("manu", "tran", "post", "con", "sub"))  # manuscripts and the like
    return [
        (SCRIPTING, "|".join(near(SCRIPTING, x, 45) for x in (ENABLE, DISABLED, REQUIRED, UNSUPPORTED, TO_VIEW, "cookies", BROWSER))),
        (SCRIPTS, rf"{any_of(BROWSER)}.{{0,40}}?{written_scripts}{any_of(SCRIPTS)}|{written_scripts}(?:" + "|".join([then(SCRIPTS, BROWSER, gap=40), then(SCRIPTS, DISABLED, gap=20), then(SCRIPTS, UNSUPPORTED, gap=20), then("scripts, cookies", "must be allowed, must be enabled, required to view, required to continue", gap=6)]) + ")|" + then(UNSUPPORTED, SCRIPTS, gap=6) + "|" + then("enable, activate, allow", "scripts, cookies, popups")),
        (BROWSER, "|".join([then(YOUR, BROWSER, "does not, doesn t, is not supported, is out of date, is too old, ist veraltet, unterstützt, n est pas, ne prend, ondersteunt, is verouderd, no es compatible, non è, and reload, and refresh", gap=8), then("checking", "your, if the", "browser, connection", gap=6), then(BROWSER, "cannot start, could not start, requires, nécessite, benötigt, vereist, requiere, richiede, failed to, kann nicht starten, ne peut démarrer, kan niet starten")])),
        (RELOAD, any_of(RELOAD)),
        (NOT_FOUND, rf"{any_of(THING)}\.?{any_of(NOT_FOUND)}"),
        (REASON, rf"[4s]{number}{{2}}\.?{any_of(REASON)}"),
        (REQUESTED, near(REQUESTED, MISSING, 40)),
        (COULD_NOT_BE, then(THING, COULD_NOT_BE, SHOWN, gap=6)),
        (GONE, rf"{any_of(THING)}{any_of(GONE)}"),
        (SERVER_FAULT, any_of(SERVER_FAULT)),
        (SERVICE_DOWN, any_of(SERVICE_DOWN)),
        (MAINTENANCE, near(MAINTENANCE, DOWN, 25)),
        (TRY_AGAIN, near(TRY_AGAIN, AGAIN_LATER, 15)),
        (EXPIRED, rf"{any_of(YOUR)}{any_of(SESSION)}.{{0,25}}?{any_of(EXPIRED)}|{any_of(SESSION)}(?:{phrase('has')}|{phrase('is')})?{any_of(EXPIRED)}\.{any_of(ADDRESSED)}|{any_of(EXPIRED)}\.{{0,2}}{any_of(ADDRESSED)}.{{0,4}}?{any_of(LOGIN)}"),
        (DENIED, rf"{any_of(DENIED)}\.{{1,2}}{any_of(ADDRESSED)}|{begin}{any_of(DENIED)}{end}"),
        (PERMISSION, then(PERMISSION, TO_DO, gap=14)),
        (LOGIN, rf"{any_of(LOGIN)}.{{0,8}}?{any_of(ONWARDS)}|{phrase('please')}{phrase('sign in again')}"),
        (INVALID, any_of(INVALID)),
        (TOO_MANY, rf"{any_of(TOO_MANY)}\.{{0,2}}.{{0,6}}?{any_of(WAIT)}|{begin}{any_of(TOO_MANY)}{end}"),
        (WRONG, near(WRONG, SORRY, 6) + "|" + then(WRONG, REPORTED, gap=6)),
        ("our team has been", then("our team has been", "told, notified, informed", "problem, error, issue", gap=14)),
        (PROGRAM, any_of(PROGRAM)),
        (ON_LINE, rf"{any_of(SAYS_ERROR)}.{{1,60}}?{any_of(ON_LINE)}{number}"),
        (ERROR_NUMBER, rf"{any_of(ERROR_NUMBER)}{number}{{0,2}}{end}"),
        (GOES_HERE, any_of(GOES_HERE)),
        (HERE, rf"{any_of(HERE)}\.{{0,2}}(?:{any_of(HERE)}|{any_of(FOLLOWS)})"),
        (FOLLOWS, rf"({any_of(FOLLOWS)})\.{{0,2}}\1"),
        (INSERT, any_of(INSERT)),
        (DUMMY_TEXT, rf"{any_of(THIS_IS)}{any_of(DUMMY_TEXT)}|({any_of(DUMMY_TEXT)})\.{{0,2}}\1"),
        (FILLS, near(FILLS, PURPOSE, 25)),
        (TEST_PAGE, near(TEST_PAGE, NO_PUBLISHING, 8)),
    ]


#: Letters of folded texts from the rarest on.
RARE = "xzkpwgmdshtrnio"
#: Those of them that most positions have.
OFTEN = "shtrnio"


def anchor_pattern(anchors: list[str] | None = None) -> str:
    """Whether a text has any word of these anchors (all there are, if none are given), in one quick pass: each word is looked for from its rarest letter on."""
    words = {max(map(squeeze, w.split(".")), key=len) for a in anchors or [a for a, _ in rules()] for w in listed(a)}
    if anchors is None:
        words |= {squeeze(w) * 2 for w in REPEATED.split()} | {"xxx", squeeze("lorem ipsum")} | {squeeze(w) for w in MOCK_LATIN.split() if len(w) >= LONG}
    words = {w for w in words if not any(o != w and o in w for o in words)}
    by_letter: dict[str, dict[str, list[str]]] = {}
    for w in words:
        i = min(range(len(w) - 1), key=lambda j: (RARE.find(w[j]) if w[j] in RARE else -1, RARE.find(w[j + 1]) if w[j + 1] in RARE else -1))
        by_letter.setdefault(w[i], {}).setdefault(w[i + 1 :], []).append(w)
    letters = sorted(by_letter, key=RARE.find)
    # from the letter on branch by branch; what precedes it is looked at last
    behind = lambda ends: {rest: "(?:" + "|".join(f"(?<={w})" for w in sorted(ws)) + ")" for rest, ws in ends.items()}
    each = {c: c + branches(behind(by_letter[c])) for c in letters}
    seldom = [c for c in letters if c not in OFTEN]
    return "|".join([f"(?=[{''.join(seldom)}])(?:" + "|".join(each[c] for c in seldom) + ")", *(each[c] for c in letters if c in OFTEN)])


def branches(ends: dict[str, str]) -> str:
    """Texts and what must follow each of them, as a regular expression that branches by letter."""
    here = [ends[""]] if "" in ends else []
    by_first: dict[str, dict[str, str]] = {}
    for text, then_ in ends.items():
        if text:
            by_first.setdefault(text[0], {})[text[1:]] = then_
    parts = [*(re.escape(c) + branches(rest) for c, rest in sorted(by_first.items())), *here]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def squeeze(words: str) -> str:
    return "".join(fold(w) for w in words.split())


def filler_pattern() -> str:
    """A word set over and over, rows of x, or "lorem ipsum" with two words in the shape of Latin after it, in folded text with blanks."""
    words = "|".join(sorted({fold(w) for w in REPEATED.split()}, key=len, reverse=True))
    living = "|".join(sorted({fold(w) for w in LIVING.split()}))
    gap, latin = r"[\s.,]{1,3}", rf"(?!(?:{living})\b)[\p{{L}}]+(?:nm|ns|is|om|ot|it|or|ir|nr|o|i)\b"
    return rf"\b({words})\b(?:\s{{1,3}}\1\b){{2}}|(?:\bx{{3,}}[ .,\n]{{0,3}}){{3,}}|{fold('lorem')}{gap}{fold('ipsum')}{gap}{latin}{gap}{latin}"


def known_latin_pattern() -> str:
    """Five words of the usual vocabulary in a row, of which one has at least LONG letters; in lower case, not folded."""
    words = MOCK_LATIN.split()
    inside = r"(?=(?:\p{L}+[\s.,]{1,3}){0,4}(?:" + "|".join(w for w in words if len(w) >= LONG) + r")\b)"
    return rf"\b{inside}(?:(?:{tree(words)})\b[\s.,]{{1,3}}){{4}}(?:{tree(words)})\b"


def made_up_latin_patterns() -> tuple[str, str]:
    """Words in the shape of Latin, none of them of LIVING: six in a row with at most two that end in a vowel between them; and a text that has nothing else. In lower case, not folded."""
    living = "|".join(sorted(set(LIVING.split())))
    word = lambda ends: rf"\p{{L}}{{2,}}+(?<=(?:{ends}))(?<!\b(?:{living}))"
    ends = "um|us|is|am|em|im|or|ur|ir|[^a]it|at|et|unt"
    strong, weak, gap = word(ends), word("[aeio]"), r"[\s.,]{1,3}"
    row = rf"[msrt][\s.,](?<=(?:{ends})[\s.,])[\s.,]{{0,2}}(?:(?:{weak}{gap}){{0,2}}{strong}{gap}){{4}}(?:{weak}{gap}){{0,2}}{strong}"  # begins with the end of a word, which few words have
    alone = rf"^(?=(?:[^\n]{{0,400}}?\b{strong}){{3}})[\s.,]*(?:(?:{strong}|{weak})[\s.,]+){{4}}(?:(?:{strong}|{weak})[\s.,]*)+$"
    return row, alone


def tree(words: list[str]) -> str:
    """A regular expression for any of the words as whole ones, which branches by letter, so that a position is left after a letter or two."""
    root: dict = {}
    for w in words:
        at = root
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def expression(node: dict) -> str:
        branches = [re.escape(c) + expression(n) for c, n in sorted(node.items()) if c]
        one = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        return "" if not branches else f"(?:{one})?" if "" in node else one

    return expression(root)
