"""Fixed values of the study-card domain: vocabularies, patterns and limits."""

# Enumerations.
KNOWLEDGE_KINDS = (
    "fact", "definition", "relation", "comparison", "ordered-process", "procedure", "mechanism", "taxonomy",
    "argument", "narrative", "formula", "derivation", "example", "exception", "application",
)
LEARNING_PURPOSES = ("recall", "discriminate", "sequence", "explain", "interpret", "derive", "apply")
ORIGINS = ("source", "inferred", "generated-enrichment")
UNIT_STATUSES = ("represented", "deferred", "unsupported", "omitted")
CARD_TYPES = ("qa", "cloze", "reverse", "typed", "list", "image-supported")
FACT_TYPES = ("qa", "cloze", "list", "typed", "image_occlusion")
DISTRACTOR_GRADES = ("far", "medium", "near")

# Limits.
MAX_FRONT_WORDS = 19
MAX_COMPONENTS = 4
MAX_LIST_ITEMS = 8
MAX_LIST_ITEM_WORDS = 12
MATURE_DAYS = 21
APPROVAL_TARGET = 0.9

# Cues of knowledge kinds, tested in the order of KIND_ORDER.
KIND_CUES = {
    "example": ("example", "for example", "for instance", "such as"),
    "exception": ("except", "exception", "unless", "however", "but not", "only when"),
    "application": ("calculate", "compute", "solve", "apply", "given that", "scenario"),
    "derivation": ("derive", "derivation", "prove", "proof"),
    "argument": ("claim", "evidence", "premise", "conclusion", "argue", "argues", "therefore", "objection"),
    "procedure": ("step", "steps", "procedure", "instructions", "how to"),
    "ordered-process": ("first", "second", "third", "finally", "stage", "phase"),
    "narrative": ("before", "after", "then", "eventually", "turning point", "protagonist"),
    "comparison": ("versus", "compared with", "differ from", "differs from", "whereas", "unlike", "similar"),
    "mechanism": ("because", "cause", "causes", "result in", "results in", "lead to", "leads to", "thereby", "through which"),
    "taxonomy": ("include", "includes", "contain", "contains", "consists of", "type of", "types of", "categories of"),
    "definition": ("is defined as", "means", "refers to", "what is", "define"),
    "relation": ("is", "are", "has", "have", "use", "uses", "produce", "produces", "require", "requires", "prevent", "prevents", "allow", "allows"),
    "formula": ("formula", "equation", "equal", "equals", "ratio", "rate", "percentage"),
}
KIND_ORDER = (
    ("example", "interpret"), ("exception", "discriminate"), ("application", "apply"), ("derivation", "derive"), ("formula", "apply"),
    ("argument", "interpret"), ("procedure", "sequence"), ("ordered-process", "sequence"), ("narrative", "sequence"), ("comparison", "discriminate"),
    ("mechanism", "explain"), ("taxonomy", "recall"), ("definition", "recall"), ("relation", "recall"),
)
FORMULA_PATTERN = r"(?:[A-Za-z][A-Za-z0-9_]*|[0-9]+)\s*=\s*[^=]|\\(?:frac|sum|int|sqrt)\b"
DEFINITION_SHAPE = r"(?i)^[^.!?]{1,80}\s+is\s+[^.!?]+[.!?]?$"

# Verbs of relation.
RELATION_VERBS = (
    "is are was were has have include includes contain contains consist consists comprise comprises cause causes mean means refer refers require requires "
    "use uses produce produces prevent prevents allow allows convert converts form forms bind binds regulate regulates encode encodes represent represents "
    "transmit transmits occur occurs release releases generate generates store stores transfer transfers transport transports control controls determine determines "
    "describe describes define defines equal equals measure measures involve involves enable enables reduce reduces increase increases decrease decreases"
).split()
CLAUSE_MARKERS = ("was", "were", "appeared", "placed", "challenged")
SUBORDINATORS = ("since", "because", "when", "although", "if", "while", "as", "after", "before", "unless", "until", "though")
SEQUENCE_CUES = ("shift", "move", "progress", "proceed", "transition", "sequence", "hierarchy", "scale", "pathway", "continuum")
NO_SPLIT_WORDS = ("but", "whereas", "while", "however", "therefore", "because", "evidence", "claim", "exception")
NO_ENUMERATION_WORDS = ("whereas", "while", "because", "however", "therefore", "but")
PARAGRAPH_STARTERS = ("First", "Second", "Third", "Finally", "Before", "After", "Because", "However", "Unlike", "For example", "An exception")
STOPWORDS = (
    "and", "the", "this", "that", "with", "from", "into", "what", "when", "where", "which", "able", "students", "learners",
    "explain", "identify", "understand", "describe", "apply",
)
ABBREVIATIONS = (
    "e.g", "i.e", "etc", "vs", "al", "cf", "approx", "no", "fig", "eq", "dr", "mr", "mrs", "ms", "prof", "st", "mt", "u.s", "u.k", "ph.d",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
)
TECHNICAL_WORDS = ("theorem", "algorithm", "enzyme", "protocol", "doctrine", "statute", "coefficient", "derivative", "mitosis", "syntax", "jurisdiction")
GENERIC_STEMS = (
    "What distinction does the source make", "What sequence does the source give", "Which procedure step is described",
    "What mechanism does the source explain", "What claim or evidence is presented", "Which event or causal link occurs",
    "Which example illustrates a concept", "Which exception or qualification applies", "What does the source state about",
    "What fact should you recall about",
)
RECALL_WORDS = ("recall", "remember", "cue", "anchor", "distinguish")

# Patterns of lines and spans, for Java's and Python's engines alike.
WORD = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"
CLOZE = r"\{\{c\d+::(.*?)(?:::[^}]*)?\}\}"
VERBATIM = r"`[^`\n]*`|\"[^\"\n]*\"|\\\([^\n]*?\\\)|\$[^$\n]+\$"
ACRONYM = r"\b[A-Z]{2,}\b"
LETTERS_DIGITS = r"\b[A-Za-z]+[0-9]+\b"
