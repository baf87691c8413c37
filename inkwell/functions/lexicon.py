"""Fixed word lists and constants of the method."""

from __future__ import annotations

# The closed-class words whose order is measured, by group.
FUNCTION_WORD_GROUPS = {
    "articles": "a an the",
    "pronouns": "i me my myself you your yours yourself he him his himself she her herself it its we us our they them their",
    "early pronouns": "thou thee thy thine thyself ye",
    "relative and demonstrative": "who whom whose which what that this these those",
    "be, have, do": "am is are was were be been have has had do does did",
    "modals": "will would shall should can could may might must",
    "early verbs": "art wert hast hath dost doth didst shalt wilt canst wouldst shouldst couldst",
    "prepositions": "of in to for with on at by from into upon unto about over under above through between against within without until",
    "conjunctions": "and but or nor if because as than though although while since",
    "adverbials": "not no never ever very too only then",
    "quantifiers": "all any some both each such more most other",
}
FUNCTION_WORDS: tuple[str, ...] = tuple(sorted(w for g in FUNCTION_WORD_GROUPS.values() for w in g.split()))
MIN_FUNCTION_WORDS, MAX_FUNCTION_WORDS = 110, 130

# Modern forms and the early forms that the offline rewriter puts for them.
SUBSTITUTIONS = {
    "you": "thou",
    "your": "thy",
    "yours": "thine",
    "are": "art",
    "have": "hast",
    "has": "hath",
    "do": "dost",
    "does": "doth",
    "did": "didst",
    "shall": "shalt",
    "will": "wilt",
    "can": "canst",
    "would": "wouldst",
    "should": "shouldst",
    "could": "couldst",
    "were": "wert",
    "upon": "on",
    "unto": "to",
    "among": "amongst",
    "while": "whilst",
}
MIN_RATE, MAX_RATE = 0.05, 0.45

# How a line of talk before an answer begins, where it ends in a colon.
LEAD_INS = ("here is", "here's", "here 's", "sure", "certainly", "rewritten", "rewrite", "below is")

# Headings of a cast list, of a text's body, of a list of contents, and of a later hand's note.
CAST_HEADINGS = (
    "dramatis personae", "dramatis personæ", "dramatis personas", "persons represented", "the persons represented", "the persons of the play", "characters in the play",
    "actor name", "actor's name", "actors' name", "the actor name", "the actor's name", "the actors' name", "the names of the actors",
)
BODY_HEADINGS = ("act i", "act 1", "act the first", "prologue", "scene i", "scene 1", "induction")
CONTENTS_HEADINGS = ("contents",)
NOTE_HEADINGS = ("transcriber note", "transcriber's note", "transcribers' note", "editor note", "editor's note", "editors' note", "producer note", "producer's note", "producers' note")

# What a refusal contains, in lower case.
REFUSAL_MARKERS = ("i cannot", "i can't", "i'm sorry", "i am sorry", "as an ai", "i'm unable", "i am unable", "i won't", "i will not")

# The keys of a style profile in their order, and their labels in a prompt.
PROFILE_LABELS = {
    "vocabulary": "Vocabulary",
    "pronouns": "Pronouns",
    "verb_forms": "Verb forms",
    "sentence_structure": "Sentence structure",
    "punctuation": "Punctuation",
    "other": "Other features",
}

# Characters stripped from the edges of a token. Apostrophes are none of them.
EDGE_PUNCTUATION = '.,;:!?"()[]{}<>*_—–-'

CHUNK_WORDS = 400
TOKENS_PER_WORD = 1.35
CONTEXT_FRACTION = 0.70
MIN_LENGTH_RATIO, MAX_LENGTH_RATIO = 0.60, 1.60
MIN_CONTENT_RETENTION = 0.50
MAX_FAILED_FRACTION = 0.02
BORDERLINE_BAND = 0.01
AGREEMENT_TOLERANCE = 0.005
MIN_SEPARABILITY = MIN_GAP_RATIO = 0.5
SEED = 20260731

assert MIN_FUNCTION_WORDS <= len(set(FUNCTION_WORDS)) == len(FUNCTION_WORDS) <= MAX_FUNCTION_WORDS
