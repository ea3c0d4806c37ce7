"""Closed vocabularies. Results depend on exactly these."""

IMMUTABLE_PROPERTIES = ("birth_place", "date_of_birth", "origin", "eye_color", "species")
MUTABLE_PROPERTIES = ("age", "location", "status")
DEAD_VALUES = ("dead", "deceased", "died", "drowned", "killed", "murdered", "slain")
ALIVE_VALUES = ("alive", "living", "alive and well", "still alive", "survived")
INCOMPATIBLE_PREDICATES = (("ENEMY_OF", "FRIEND_OF"), ("ENEMY_OF", "MARRIED_TO"), ("ALLY_OF", "DEAD_AT_HANDS_OF"))
SINGLE_SOURCE_PREDICATES = ("FATHER_OF",)
SYMMETRIC_PREDICATES = ("ALLY_OF", "ENEMY_OF", "ENGAGED_TO", "FRIEND_OF", "KNOWS", "MARRIED_TO", "RELATED_TO", "SIBLING_OF")
NEGATIVE_PREDICATES = ("ENEMY_OF", "DEAD_AT_HANDS_OF")
TITLES = (
    "captain", "capt", "doctor", "dr", "mr", "mrs", "ms", "miss", "sir", "lady", "lord", "professor", "prof", "uncle",
    "aunt", "general", "sergeant", "lieutenant", "detective", "inspector",
)
NAME_CONNECTORS = ("of", "the", "de", "van", "von", "la", "le", "du", "da")
GENDERED_TITLES = {"mr": "m", "sir": "m", "lord": "m", "mrs": "f", "miss": "f", "ms": "f", "lady": "f"}
GENDER_ROLES = {
    "m": ("father", "dad", "papa", "pa", "mr", "sir", "lord", "husband", "son", "brother"),
    "f": ("mother", "mum", "mom", "mama", "ma", "step-mother", "stepmother", "mrs", "miss", "ms", "lady", "dame", "wife", "daughter", "sister"),
}
GENDER_PRONOUNS = {"m": ("he", "him", "his", "himself"), "f": ("she", "her", "hers", "herself")}
ROLE_DETERMINERS = ("a", "an", "the", "his", "her", "my", "our", "their", "your", "its")
IRREGULAR_PLURALS = ("children", "people", "men", "women", "folk", "folks", "family", "parents")
UNITS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
MENTION_TYPES = ("character", "location", "object", "organization", "other")
PARTICIPANT_ROLES = ("agent", "patient", "target", "recipient", "location", "instrument", "participant")
PRONOUNS = ("i", "me", "my", "you", "he", "him", "his", "she", "her", "hers", "it", "its", "we", "us", "they", "them", "their")
NONE_WORDS = ("", "none", "null", "n/a", "na", "unknown", "not stated", "not mentioned")
EDITION_QUOTES = ("‘’“”", "''\"\"")

# Fixed values of fact and relation answers.
TITLE_OCCUPATIONS = {"doctor": "doctor", "dr": "doctor", "professor": "professor", "prof": "professor", "detective": "detective", "inspector": "inspector"}
TITLE_RANKS = {"capt": "Captain"} | {w: w.capitalize() for w in "captain general sergeant lieutenant colonel admiral sir lady lord dame".split()}
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred score"
).split()
PLACE_PROPERTIES = ("birth_place", "origin")
DETERMINERS = ("the ", "this ", "that ", "a ", "an ")
COLOURS = (
    "black brown dark blond blonde red auburn ginger grey gray white silver golden gold fair light pale chestnut copper green "
    "blue hazel amber violet pink purple orange yellow raven jet"
).split()
FREE_PROPERTIES = ("age", "date_of_birth", "status")
PARENT_CUES = ("mother", "father", "mom", "dad", "parent", "son", "daughter", "child")
RELATION_CUES = {
    "FRIEND_OF": ("friend", "buddy", "pal"),
    "ENEMY_OF": ("enem", "rival", "nemes", "hate"),
    "SIBLING_OF": ("brother", "sister", "sibling", "twin"),
    "PARENT_OF": PARENT_CUES,
    "MARRIED_TO": ("married", "marry", "wife", "husband", "spouse", "wedding"),
    "ALLY_OF": ("ally", "allie", "alliance", "side with", "team"),
    "WORKS_FOR": ("boss", "employ", "work", "job", "hire", "part-timer", "coworker", "manager", "owner"),
    "MEMBER_OF": ("member", "joined", "belong"),
    "OWNS": ("own",),
    "KNOWS": ("know", "knew", "met ", "meet", "friend", "recogni"),
    "RELATED_TO": ("related", "cousin", "aunt", "uncle", "niece", "nephew", "grand", "family", "relative"),
    "CHILD_OF": PARENT_CUES,
}
FIRST_PERSON = ("i", "me", "my", "myself", "we", "us", "our")
#: Phrase, predicate, whether the first name is the subject.
RELATION_OPTIONS = (
    ("{a} is the father of {b}", "FATHER_OF", True),
    ("{b} is the father of {a}", "FATHER_OF", False),
    ("{a} is the mother of {b}", "MOTHER_OF", True),
    ("{b} is the mother of {a}", "MOTHER_OF", False),
    ("{a} is a parent of {b}", "PARENT_OF", True),
    ("{b} is a parent of {a}", "PARENT_OF", False),
    ("{a} and {b} are siblings", "SIBLING_OF", True),
    ("{a} and {b} are married", "MARRIED_TO", True),
    ("{a} and {b} are engaged", "ENGAGED_TO", True),
    ("{a} and {b} are other relatives", "RELATED_TO", True),
    ("{a} and {b} are friends", "FRIEND_OF", True),
    ("{a} and {b} are enemies", "ENEMY_OF", True),
    ("{a} and {b} are allies", "ALLY_OF", True),
    ("{a} and {b} know each other", "KNOWS", True),
    ("{a} works for {b}", "WORKS_FOR", True),
    ("{b} works for {a}", "WORKS_FOR", False),
    ("{a} is a member of {b}", "MEMBER_OF", True),
    ("{b} is a member of {a}", "MEMBER_OF", False),
    ("{a} owns {b}", "OWNS", True),
    ("{b} owns {a}", "OWNS", False),
)
DEFAULT_PREFERENCES = {"chat_reply_length": "medium", "review_preselect_new": "true"}
REPLY_LENGTHS = ("short", "medium", "long")
