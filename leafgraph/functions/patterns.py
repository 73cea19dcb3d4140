"""Patterns and word lists.

Every regular expression here is valid for Java and for RE2, so that a check in
another engine can share it.  Multi-entry tables are fixed values: results depend
on them, and they are listed in matching order.
"""

# Characters removed by a trim.
WHITESPACE = " \t\n\r\x0b\f"

# --- tables of contents -----------------------------------------------------

# Words that announce a table of contents (matched on lower case).
TOC_INDICATORS = [
    r"table\s+of\s+contents",
    r"contents",
    r"toc",
    r"índice",
    r"table\s+des\s+matières",
    r"inhaltsverzeichnis",
]
LINE_END_NUMBER = r"(?m)\b\d+\s*$"
DOTS_NUMBER = r"\.{2,}\s*\d+"
TAB_NUMBER = r"\t\d+"

DOT_LEADER = r"\.{2,}"
NUMBERED_START = r"^\d+(?:\.\d+)*\s+"

DOT_ENTRY = r"^([\d.]+)?\s*(.+?)\s*\.{2,}\s*(\d+)$"
TAB_ENTRY_3 = r"^([\d.]+)?\t(.+?)\t(\d+)$"
TAB_ENTRY_2 = r"^(.+?)\t(\d+)$"
NUMBERED_ENTRY = r"^([\d.]+)\s+(.+?)\s+(\d+)$"
TRAILING_NUMBER = r"\b(\d+)$"
LEADING_NUMBER = r"^([\d.]+)\s+"

# --- headings ---------------------------------------------------------------

MARKDOWN_HEADING = r"^(#+)\s+(.+)$"
DOTTED_HEADING = r"^((?:\d+\.)+)\s+(.+)$"
FORMAL_HEADING = r"^(?:CHAPTER|Chapter|Section|SECTION)\s+\d+[:.]?\s*(.+)$"
CAPS_HEADING = r"^[A-Z][A-Z\s]+$"

# Heading patterns with their type and confidence, in matching order.
HEADING_PATTERNS = [
    ("numbered", r"^(\d+(?:\.\d+)*)\s+([A-Z].*?)$", 0.9),
    ("chapter", r"^(Chapter\s+\d+:?)\s+(.+)$", 0.95),
    ("markdown", r"^(#{1,6})\s+(.+)$", 0.85),
    ("roman", r"^([IVXLCDM]+\.?)\s+(.+)$", 0.7),
    ("lettered", r"^([A-Z]\.)\s+(.+)$", 0.7),
    ("uppercase", r"^([A-Z][A-Z\s]+)$", 0.6),
]

# Words that make a heading more certain.
HEADING_KEYWORDS = [
    "introduction", "conclusion", "summary", "abstract", "preface", "foreword",
    "appendix", "references", "bibliography", "glossary", "index", "acknowledgments",
]

PAGE_MARKER = r"(?:^|\n)(Page \d+)"

# --- words ------------------------------------------------------------------

TOKEN = r"[\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"[.!?]+"
ENTITY_TOKEN = r"[\p{L}\p{N}_-]+|[^\s\p{L}\p{N}_-]"
CAPITALISED = r"^\p{Lu}"
TECHNICAL = r"[\p{Nd}_-]"

# English function words that carry no topic.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what
which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for
with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn
hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()

# Words every document uses about itself.
DOMAIN_STOP_WORDS = [
    "page", "figure", "table", "chapter", "section",
    "example", "note", "see", "also", "above", "below",
]

STOP_WORDS = sorted(set(ENGLISH_STOP_WORDS) | set(DOMAIN_STOP_WORDS))

# Indicator phrase and the relation it announces.
RELATION_INDICATORS = [
    ("is a", "type_of"),
    ("is an", "type_of"),
    ("are", "type_of"),
    ("includes", "contains"),
    ("contains", "contains"),
    ("consists of", "contains"),
    ("part of", "part_of"),
    ("related to", "relates_to"),
    ("similar to", "similar_to"),
    ("such as", "example_of"),
    ("for example", "example_of"),
    ("e.g.", "example_of"),
    ("i.e.", "definition"),
    ("means", "definition"),
    ("refers to", "references"),
    ("see", "references"),
]

# Analysis relation to edge type.
RELATION_TYPE_EDGES = {
    "type_of": "part_of",
    "contains": "contains",
    "part_of": "part_of",
    "relates_to": "relates_to",
    "similar_to": "similar_to",
    "example_of": "example_of",
    "definition": "defines",
    "references": "references",
    "co_occurrence": "relates_to",
}

# Keyword in a free-text relation, edge type, whether the ends swap.
RELATION_TEXT_EDGES = [
    ("contains", "contains", False),
    ("references", "references", False),
    ("relates to", "relates_to", False),
    ("part of", "part_of", False),
    ("similar to", "similar_to", False),
    ("contradicts", "contradicts", False),
    ("supports", "supports", False),
    ("defines", "defines", False),
    ("example of", "example_of", False),
    ("summarizes", "summarizes", False),
    ("precedes", "precedes", False),
    ("follows", "precedes", True),
    ("derived from", "derived_from", False),
]

# Decay per step of a relation type (0.1 for a type not listed).
RELATION_DECAY = {
    "contains": 0.0,
    "references": 0.1,
    "relates_to": 0.2,
    "supports": 0.1,
    "contradicts": 0.05,
    "defines": 0.0,
}

# Relation types and their inverse.
INVERSE_TYPES = {
    "contains": "is_part_of",
    "is_part_of": "contains",
    "references": "referenced_by",
    "referenced_by": "references",
    "supports": "supported_by",
    "supported_by": "supports",
    "relates_to": "relates_to",
    "contradicts": "contradicts",
}

# Price in dollars per token, (input, output).
MODEL_PRICES = {
    "gpt-4-vision-preview": (0.01 / 1000, 0.03 / 1000),
    "gpt-4-turbo": (0.01 / 1000, 0.03 / 1000),
    "gpt-4o": (0.005 / 1000, 0.015 / 1000),
    "gpt-4o-mini": (0.00015 / 1000, 0.0006 / 1000),
}
DEFAULT_PRICE = (0.01 / 1000, 0.03 / 1000)

# Seconds per page by a word in the model name, and otherwise.
SECONDS_PER_PAGE = [("llava", 5.0), ("phi", 3.0)]
DEFAULT_SECONDS_PER_PAGE = 4.0
