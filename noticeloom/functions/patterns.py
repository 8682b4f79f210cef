r"""Vocabularies, formats and patterns of notices, as Java regular expressions unless said otherwise.

Words are listed as the stems that texts are searched for; :func:`any_of` makes a pattern of a list. What must have exactly
these values for right results stands under a remark "Fixed values".
"""


def any_of(*stems: str) -> str:
    """A pattern that finds any of the stems."""
    return "|".join(stems)


def starting(*stems: str) -> str:
    """A pattern that finds a line that starts with one of the stems."""
    return rf"^\s*(?:{any_of(*stems)})"


# HTML entities of the sources' texts and the plain characters that stand for them.
ENTITIES = {
    "amp": "&", "quot": '"', "apos": "'", "nbsp": " ", "rsquo": "'", "lsquo": "'", "rdquo": '"', "ldquo": '"', "laquo": '"', "raquo": '"',
    "ndash": "-", "mdash": "-", "hellip": "...", "deg": "°", "egrave": "è", "eacute": "é", "agrave": "à", "ograve": "ò", "ugrave": "ù",
    "igrave": "ì", "Egrave": "È", "Agrave": "À",
}

# The shapes of class codes, in the order in which they are tried: @ a letter, # a digit, - and ~ dashes that may be missing.
CLASS_SHAPES = ("ADAA", "ADEE", "ADMM", "ADSS", "AA@@", "EE@@", "A-###", "A-##", "B-###", "B-##", "A@~##", "B@~##", "A@#@")

# Phrases (see phrases.py) on support posts and common posts, and the class that each grade stands for.
SUPPORT = ("sostegno", " eh ", " ch ", " dh ", "psicofisic")
SUPPORT_OVERRIDES = (("ADSS", (" ss2g ", " ss 2g ", " ss2 g ", " ss 2 g ")), ("ADMM", (" ss1g ", " ss 1g ", " ss1 g ", " ss 1 g ")))
SUPPORT_GRADES = (
    ("ADSS", ("ii grado", "2 grado", "secondo grado", "superiore")),
    ("ADMM", ("i grado", "1 grado", "primo grado", "media")),
    ("ADEE", ("primaria", "elementare")),
    ("ADAA", ("infanzia", "materna")),
)
COMMON_POST = ("posto comune", "comune infanzia", "comune primaria", "comune scuola infanzia", "comune scuola primaria")
COMMON_POST_CLASSES = (("AAAA", ("infanzia", "materna")), ("EEEE", ("primaria", "elementare")))

# Phrases that tell the type of a notice, the first type that has one; and the staff that it is for.
NOTICE_TYPES = (
    ("annullamento", ("annull", "revoc", "ritir")),
    ("rettifica", ("rettific", "errata corrige", "^^integrazione", "integrazione a ", "integrazione al ", "integrazione all ", "integrazione alla ", "integrazione dell ")),
    ("riapertura", ("^proroga", "^riapertura", "prorogata al", "prorogato al", "riapertura termin", "riapertura dei termin", "proroga scadenza", "proroga della scadenza")),
    ("esito", (" esito ", "individuata ", "individuato ", "decreto di individuazione", "decreto di nomina")),
)
DEFAULT_TYPE = "interpello"
STAFF = (
    ("ata-dsga", (
        " ata ", "dsga", "d s g a", "direttore dei servizi", "collaboratore scolastic", "collaboratori scolastic", "assistente amministrativ", "assistente tecnic",
        "assistenti amministrativ", "assistenti tecnic",
    )),
    ("altro", ("pnrr", "esperto", "tutor", "progettist", "collaudator", "psicolog", "figura di sistema", "figure di sistema", "educator")),
)
DEFAULT_STAFF = "docente"

# How protocol numbers, school codes, hours and end dates are written.
WRITTEN_DATE = r"\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}"
PROTOCOL = rf"(?i)prot(?:ocollo)?\.?\s*(?:n\.?\s*)?(\d(?:[\d/.]*\d)?)(?:\D{{0,25}}?del\s*({WRITTEN_DATE}))?"
SCHOOL_CODE = r"\b[A-Z]{4}\d{5}[0-9A-Z]\b"
HOURS = r"(?i)(\d{1,2})\s*(?:h\b|ore)"
UNTIL = rf"(?i)(?:fino )?al\s*({WRITTEN_DATE})"
UNTIL_PHRASE, UNTIL_TEXT = r"(?i)termine delle attivit", "termine delle attività"

# Words and phrases of documents: where the subject is, where the body begins, what names a form, a notice, an addressee, an authority.
SUBJECT_LINE = r"(?i)^\s*oggetto\s*[:.\-–]?\s*"
BODY_START = "(?i)dirigente|" + starting("vist[oaie]", "premess", "considerat", "constatat", "verificat", "preso atto", "emette", "decreta", "dispone", "rende noto", "si comunica", "comunica") + r"\b"
FORM_NAME = ("modello", "domanda", "allegat", "dichiarazion", "modulo", "istanza")
FORM_SUBJECT = ("messa a disposizione", " mad ", "domanda", "dichiarazion", "istanza", "modello", "modulo")
NOTICE_SUBJECT = ("interpell", "supplen", "avviso", "incaric", "reclutament", "individuazion", "conferiment", "nomin", "copertura", "sostituzion", "posti")
ADDRESSEE_LINE = "(?i)" + starting("al", "all['’]", "alla", "alle", "agli", "ai", "ambito territoriale") + r"(?:\s|['’]|$)"
AUTHORITY_LINE = "(?i)" + any_of("ministero", "ufficio scolastico", r"u\.\s?s\.\s?r\.", "unione europea", "repubblica italiana", "regione ")
SCHOOL_CODE_LOOSE = r"\b[A-Z]{4}\d[0-9A-Z]{5}\b"
SCHOOL_EMAIL = r"(?i)\b([a-z]{4}\d[0-9a-z]{5})@(?:pec\.)?istruzione\.it"
OFFICE_EMAIL = r"(?i)\busp\.([a-z]{2})@"

# What kinds of schools are called, at the start of a letterhead's line and inside a heading.
LETTERHEAD_KINDS = (
    "circolo", "istituto", "liceo", "convitto", "educandato", "cpia", r"c\.\s?p\.\s?i\.\s?a", "scuola", "polo", r"i\.\s?c\.", r"i\.\s?i\.\s?s", r"i\.\s?t\.", r"i\.\s?p\.",
    "itis", "ites", "itet", "ipsia", "ipsseoa", "ipssar",
)
ORDINAL = r"\d?\s*°?\s*(?:I|II|III|IV|V|VI|VII|VIII|IX|X)?\s*"
LETTERHEAD_SCHOOL = "(?i)" + starting(ORDINAL + f"(?:{any_of(*LETTERHEAD_KINDS)})")
HEADING_KINDS = (
    r"I\.?\s?C\.?S?\b", "Istituto", r"Ist\.", "Liceo", r"I\.?\s?I\.?\s?S\.?\s?S?\.?", r"I\.?\s?P\.?\s?S\.?\s?[A-Z.]*", r"I\.?\s?T\.?\s?[A-Z]{1,3}\.?\b", "ITIS", "ITES", "ITET",
    "IPSIA", "IPSSAR", "IPSSEOA", "Circolo", r"C\.\s?D\.", "Convitto", "CPIA", r"C\.P\.I\.A\.", "Educandato", "Scuola Secondaria", "Scuola Media", r"S\.S\.\s?[I1]", "SSPG",
    "Polo", "Comprensivo",
)
#: In Python's syntax.
HEADING_SCHOOL = rf"(?<![^\W\d_])(?:{any_of(*HEADING_KINDS)})"

# Other names of provinces, towns that are common words, and columns of the town list.
PROVINCE_ALIASES = {
    "reggio calabria": "RC", "reggio emilia": "RE", "bat": "BT", "barletta andria trani": "BT", "barletta andria": "BT", "monza": "MB",
    "monza brianza": "MB", "aosta": "AO", "bolzano": "BZ", "forli": "FC", "pesaro": "PU", "pesaro urbino": "PU", "massa carrara": "MS",
    "carbonia iglesias": "SU", "vibo": "VV",
}
IGNORED_TOWNS = (
    "sostegno", "grado", "viola", "lingua", "musica", "scuola", "nove", "sale", "salve", "re", "vo", "ne", "ro", "bella", "villa", "porto",
    "calice", "castello", "piano", "monte",
)
#: Zero-based columns of the town list.
TOWN_COLUMNS = {"names": 5, "italian": 6, "province_name": 11, "province": 14}

# Months, and the words around deadlines in folded texts (Python's syntax).
MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")
POSTPONEMENTS = ("prorogat[oaie]", "riapert[oaie]")
ANCHOR = rf"\b(?:{any_of('entro', 'non oltre', 'scadenza', r'scad(?=\.)', 'termine ultimo', 'termine di presentazione', *POSTPONEMENTS)})\b"
FOREIGN_CONTEXT = any_of("servizio", "conseguit", "contratt")
RELATIVE_TERM = any_of(r"\bgiorni\b", r"\d+\s*ore\s+(?:dall?a?)")

# What texts have that says nothing about them, members of archives that are no documents, content types, an address' shape, labels.
REGISTRY_STAMP = r"(?i)m_pi\.AOO\w+\.REGISTRO\s*UFFICIALE\s*[.(]\s*[EU]\s*[.)]\s*\d+\.\d\d-\d\d-\d{4}(\.h\.\d\d:\d\d)?"
RULERS = r"_{3,}"
NOT_A_DOCUMENT = r"(?i)(^|/)(__MACOSX/|\.|thumbs\.db$|desktop\.ini$)|\.(xml|txt|json|csv|html?|eml|p7s|sig|url|lnk)$"
DOCUMENT_TYPES = (
    "application/pdf", "application/x-pdf", "application/octet-stream", "binary/octet-stream", "application/zip", "application/x-zip-compressed",
    "application/x-7z-compressed", "application/x-rar-compressed", "application/vnd.rar", "application/msword",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.oasis.opendocument.text", "application/rtf",
    "application/pkcs7-mime", "image/jpeg", "image/png",
)
PDF_TYPES = ("application/pdf", "application/x-pdf")
EXTENSION_TYPES = {"pdf": "application/pdf", "zip": "application/zip", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
EMAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"
#: Why documents weren't read before scans and archives could be; these are fetched again.
READ_BY_OLD_RULES = r"^(formato non ancora letto|PDF senza testo)"
MISSING_CLASS, MISSING_PROVINCE, UNREADABLE = "classe di concorso non specificata", "provincia non specificata", "documento non leggibile"
SHORT_MONTHS = ("gen", "feb", "mar", "apr", "mag", "giu", "lug", "ago", "set", "ott", "nov", "dic")
