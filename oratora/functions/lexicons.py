"""Word lists, name tables and thresholds. Results depend on each entry.

Everything here is a default; the operators take their lists as parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, field


def _set(text: str) -> frozenset[str]:
    """Entries separated by commas; line breaks don't matter."""
    return frozenset(" ".join(x.split()) for x in text.split(",") if x.strip())


# fixed values
CRISIS = _set("""
crisi, emergenza, pericolo, allarme, allerta, rischio, minaccia, urgenza, urgente, urgentissimo, immediato,
catastrofe, catastrofico, disastro, disastroso, tragedia, tragico, dramma, drammatico, apocalisse, apocalittico, cataclisma,
collasso, crollo, fallimento, fallito, sfacelo, disfatta, rovina, rovinoso, distruzione, devastazione, devastante,
caos, caotico, panico, terrore, terrorizzante, paura, spaventoso, orrore, orribile, incubo, nightmare,
grave, gravissimo, critico, criticità, serio, serissimo, preoccupante, allarmante, inquietante, sconvolgente,
vergogna, vergognoso, scandalo, scandaloso, indecente, inaccettabile, intollerabile, inammissibile, assurdo,
baratro, abisso, precipizio, declino, decadenza, degrado, peggioramento, deterioramento, aggravarsi, sprofondare,
sofferenza, dolore, morte, morire, vittime, feriti, malattia, epidemia, pandemia, contagio,
bancarotta, insolvenza, default, recessione, depressione, inflazione, stangata, salasso, austerity,
guerra, conflitto, attacco, bombardamento, invasione, violenza, scontro, rivolta, sommossa
""")
POSITIVE = _set("""
crescita, sviluppo, opportunità, successo, eccellenza, miglioramento, progresso, innovazione, ottimismo, ripresa,
speranza, fiducia, entusiasmo, soddisfazione, orgoglio, traguardo, conquista, vittoria, risultato, obiettivo,
positivo, favorevole, promettente, incoraggiante, brillante
""")
NEGATIVE = _set("""
declino, peggioramento, fallimento, crisi, problema, difficoltà, ostacolo, rischio, pericolo, minaccia,
preoccupazione, timore, paura, ansia, incertezza, delusione, frustrazione, rabbia, indignazione, sconforto,
negativo, sfavorevole, allarmante, inquietante, devastante
""")
PRONOUNS = _set("noi, loro, voi, nostro, nostra, nostri, nostre, vostro, vostra, vostri, vostre")
ADVERSATIVES = _set("""
contro, nemici, nemico, avversari, avversario, opposti, opposto, combattere, combattiamo, sconfiggere,
respingere, respingiamo, bloccare, fermare, impedire, difendere, difendiamo, proteggere, proteggiamo,
minacciano, attaccano, vogliono, pretendono
""")
US_THEM = ("noi contro loro", "noi e loro", "da una parte", "dall'altra parte", "chi sta con", "chi sta contro", "chi vuole", "chi non vuole")

POPULIST = _set("""
élite, elite, casta, popolo, gente, cittadini, traditi, sistema, establishment, palazzo, potere, potenti, oligarchia,
banche, banchieri, lobby, burocrati, tecnocrati, privilegiati
""")
ANTI_ESTABLISHMENT = _set("""
vergogna, scandalo, corruzione, corrotti, ladri, rubato, fallimento, fallito, disastro, disastroso, inaccettabile,
intollerabile, responsabili, colpevoli, immorale, indegno
""")
EMOTIONAL = _set("""
assolutamente, completamente, totalmente, incredibile, incredibilmente, gravissimo, gravissima, urgente, urgentissimo, drammatico,
drammaticamente, straordinario, eccezionale, storico, epocale, fondamentale, cruciale, vitale, essenziale, indispensabile
""")
INSTITUTIONAL = _set("""
proposta, emendamento, normativa, legislazione, procedura, regolamento, commissione, relazione, parere, valutazione,
analisi, studio, dati, statistiche, documento, articolo, comma, decreto, disposizione, provvedimento, iter
""")

SELF_REFERENCE = _set("io, mio, mia, miei, mie, me, mi, personalmente")
NEGATION = _set("non, no, mai, nessuno, nulla, niente, neanche, nemmeno, neppure, senza")
FUTURE = _set("""
sarà, saranno, saremo, sarete, faremo, faranno, farete, vogliamo, vogliono, vorremo, proponiamo, proporremo,
futuro, domani, prossimo, prossima, prossimi, prossime, sviluppo, crescita, obiettivo, obiettivi, progetto, progetti
""")
# two entries of two words each never match a single token; they are part of the list all the same
PAST = _set("""
era, erano, eravamo, fu, furono, fummo, abbiamo fatto, hanno fatto, passato, ieri, precedente, precedenti,
storia, storico, tradizione, tradizionale
""")
#: Leftmost alternative first, without overlap, case ignored.
NUMERIC = r"\d+%|€\s?\d+|\d+\s?euro|\d+\s?(milioni|miliardi)|\d{4}|\d+[\.,]\d+"

#: Six further lists of words and phrases for plain lexicon scores.
LEXICONS = {
    "populist": _set("""
popolo, gente, cittadini, italiani, paese reale, gente comune, persone normali, persone oneste, famiglie, lavoratori, contribuenti, risparmiatori,
classe media, ceti popolari, maggioranza silenziosa, buonsenso, buon senso, senso comune, volontà popolare, sovranità popolare, voce del popolo
"""),
    "anti_establishment": _set("""
élite, elite, casta, privilegiati, privilegio, privilegi, palazzo, palazzi del potere, poteri forti, potere forte, establishment, sistema, sistemico,
oligarchia, oligarchi, lobby, lobbisti, lobbying, clientela, clientelismo, clientelare, corruzione, corrotto, corrotti, malaffare,
burocrazia, burocrati, burocratico, mainstream, media di regime, giornaloni
"""),
    "institutional": _set("""
istituzione, istituzioni, istituzionale, istituzionali, costituzione, costituzionale, costituzionali, carta costituzionale, repubblica, repubblicano, repubblicana,
democrazia, democratico, democratica, democratici, stato di diritto, rule of law, certezza del diritto, legalità, legale, legittimità, legittimo,
regole, regola, regolamento, regolamenti, procedura, procedure, procedurale, procedurali, trasparenza, trasparente, accountability,
bipartisan, condivisione, condiviso, unitario, unità
"""),
    "emotional": _set("""
vergogna, vergognoso, vergognosa, scandalo, scandaloso, scandalosa, inaccettabile, intollerabile, inammissibile, indegno, indecente, indecoroso,
assurdo, assurdità, follia, folle, incredibile, inconcepibile, incomprensibile, gravissimo, grave, gravi, gravità,
drammatico, drammatica, dramma, tragedia, tragico, emergenza, urgenza, urgente, urgentissimo, crisi, critico, critica, disastro, disastroso,
pericolo, pericoloso, pericolosa, minaccia, minaccioso, devastante, catastrofe, catastrofico
"""),
    "sovereignist": _set("""
sovranità, sovrano, sovranista, sovranismo, patria, patriota, patriottico, patriottismo, nazione, nazionale, nazionali, nazionalismo,
confini, confine, frontiera, frontiere, identità, identitario, tradizione, tradizioni, tradizionale, autodeterminazione, indipendenza, autonomia
"""),
    "progressive": _set("""
diritti, diritto, tutela, tutelare, garanzia, garantire, uguaglianza, uguale, uguali, parità, pari opportunità, inclusione, inclusivo, inclusiva, inclusività,
diversità, diverso, diversa, pluralismo, plurale, discriminazione, discriminato, discriminata, antidiscriminazione, minoranze, minoranza,
vulnerabile, vulnerabili, fragile, fragili, solidarietà, solidale, coesione, sociale, ambiente, ambientale, ecologia, ecologico, sostenibilità, sostenibile,
clima, climatico, climatica, transizione
"""),
}

KEYWORD_BLACKLIST = _set("""
dell, all, nell, dall, sull, coll, quell, quest, un, una, uno, ogni, alcun, qualch,
cosa, cose, fatto, fatti, modo, modi, tipo, tipi, volta, volte, parte, parti, punto, punti, anno, anni, mese, mesi, giorno, giorni,
momento, tempo, tempi, periodo, periodi, caso, casi, esempio, esempi, senso, sensi, base, basi, livello, livelli, numero, numeri,
fare, dire, andare, venire, vedere, sapere, potere, volere, dovere, stare, dare, prendere, mettere, trovare, portare, passare, lasciare,
parlare, pensare, credere, sentire, chiamare, grande, grandi, piccolo, piccoli, nuovo, nuovi, primo, primi, ultimo, ultimi, alto, alti,
basso, bassi, lungo, lunghi, vero, veri, importante, importanti, necessario, necessari, possibile, possibili, diverso, diversi,
proposta, proposte, richiesta, richieste, situazione, situazioni, condizione, condizioni, intervento, interventi, azione, azioni,
decisione, decisioni, scelta, scelte
""")

#: Formal phrases that cleaning deletes, in this order.
PROCEDURAL = (
    r"grazie[,]?\s*presidente",
    r"signor[a]?\s*presidente",
    r"ho facoltà di parlare",
    r"dichiaro aperta la seduta",
    r"dichiaro chiusa la seduta",
    r"la seduta è aperta",
    r"la seduta è chiusa",
    r"prego[,]?\s*onorevole",
    r"onorevoli colleghi",
    r"colleghe e colleghi",
    r"la parola al[l']?\s*(deputato|onorevole)",
    r"passiamo al punto successivo",
    r"do lettura del",
    r"procediamo con la votazione",
)

PARTY_ALIASES = {
    "FI-BP-PPE": "Forza Italia",
    "FI-PPE": "Forza Italia",
    "FORZA ITALIA": "Forza Italia",
    "FdI": "Fratelli d'Italia",
    "FDI": "Fratelli d'Italia",
    "FDI-AN": "Fratelli d'Italia",
    "LEGA": "Lega",
    "LSP-PSd'Az": "Lega",
    "LSP": "Lega",
    "PD-IDP": "PD",
    "PD": "PD",
    "M5S": "M5S",
    "IV-C-RE": "Italia Viva",
    "IV": "Italia Viva",
    "AZ-PER-RE": "Azione-RE",
    "Misto-Az-RE": "Azione-RE",
    "AZIONE-PER": "Azione-RE",
    "AVS": "AVS",
    "Misto-AVS": "AVS",
    "NM(N-C-U-I": "Noi Moderati",
    "NM(N-C-U-I)": "Noi Moderati",
    "NM": "Noi Moderati",
    "MISTO": "Misto",
    "Misto": "Misto",
    "MISTO-+EUROPA": "Misto-PiùEuropa",
    "MISTO-MIN.LING.": "Misto-MinoranzeLing",
}
LEFT = _set("Partito Democratico, PD, PD-IDP, Movimento 5 Stelle, M5S, AVS, Alleanza Verdi Sinistra, Misto-AVS, +Europa, Misto-PiùEuropa, MISTO-+EUROPA")
RIGHT = _set("Fratelli d'Italia, FdI, FDI, Lega, LEGA, Forza Italia, FI, FI-PPE, FI-BP-PPE, Noi Moderati, NM, NM(N-C-U-I), NM(N-C-U-I, Governo")
CENTER = _set("Azione, Azione-RE, Azione-IV-RE, IV-C-RE, Italia Viva, IV, Misto, MISTO")
UNKNOWN_PARTY = "Unknown Group"
UNKNOWN_PARTIES = ("?", UNKNOWN_PARTY, "")

#: Role categories in the order in which they are tried.
ROLE_CATEGORIES = {
    "governo": _set("presidente del consiglio, presidente del consiglio dei ministri, ministro, ministra, vice ministro, viceministro, viceministra, sottosegretario, sottosegretaria, sottosegretario di stato, sottosegretaria di stato"),
    "presidenza": _set("presidente, vice presidente, vicepresidente"),
    "ufficio": _set("segretario, segretaria, relatore, relatrice, questore"),
}
ROLES = frozenset().union(*ROLE_CATEGORIES.values())

MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")
# end of fixed values


def _function_words() -> frozenset[str]:
    """Italian function words by rule: articles, prepositions with them, pronouns, conjunctions, and the forms of two auxiliaries."""
    joined = [stem + ending for stem in ("a", "da", "de", "ne", "su") for ending in ("l", "llo", "lla", "ll", "lle", "i", "gli")]
    plain = (
        "il lo la i gli le l un uno una di a da in con su per tra fra e ed o od ma se anche come che chi cui non più meno molto poco tanto quanto quale quali quello quella quelli quelle questo questa questi queste "
        "io tu lui lei noi voi loro mi ti si ci vi ne me te sé mio mia miei mie tuo tua tuoi tue suo sua suoi sue nostro nostra nostri nostre vostro vostra vostri vostre "
        "dove quando perché perche mentre dopo prima poi già ancora sempre mai ora qui qua lì là così cosi solo sono tutto tutta tutti tutte altro altra altri altre ogni dunque quindi infatti però oppure né contro senza sotto sopra"
    ).split()
    to_be = "essere stato stata stati state sei è siamo siete era ero eri eravamo eravate erano sarà saranno sarebbe sarebbero sia siano fosse fossero fu furono".split()
    to_have = "avere avuto ho hai ha abbiamo avete hanno aveva avevo avevi avevamo avevate avevano avrà avranno avrebbe avrebbero abbia abbiano avesse avessero ebbe ebbero".split()
    return frozenset([*joined, *plain, *to_be, *to_have])


def read_words(path: str) -> frozenset[str]:
    """A list of one's own from a text file: words by blanks, commas or lines, lower-cased; lines after # are remarks."""
    with open(path, encoding="utf-8") as f:
        return frozenset(w for line in f for w in line.split("#")[0].lower().replace(",", " ").split())


@dataclass(frozen=True)
class LexiconSet:
    """The word lists that the metrics count, all replaceable."""

    positive: frozenset[str] = POSITIVE
    negative: frozenset[str] = NEGATIVE
    pronouns: frozenset[str] = PRONOUNS
    adversatives: frozenset[str] = ADVERSATIVES
    us_them: tuple[str, ...] = US_THEM
    crisis: frozenset[str] = CRISIS
    self_reference: frozenset[str] = SELF_REFERENCE
    negation: frozenset[str] = NEGATION
    future: frozenset[str] = FUTURE
    past: frozenset[str] = PAST
    rhetoric: dict[str, frozenset[str]] = field(default_factory=lambda: {"populist": POPULIST, "anti_establishment": ANTI_ESTABLISHMENT, "emotional": EMOTIONAL, "institutional": INSTITUTIONAL})
    #: Function words by default; ``read_words`` takes a longer list of one's own.
    stopwords: frozenset[str] = field(default_factory=_function_words)
    blacklist: frozenset[str] = KEYWORD_BLACKLIST
