"""Fixed values. Each of these is part of a result contract and must not change."""

# Java type names that never become a node or an edge target.
COMMON_TYPES = [
    "String", "Integer", "Long", "Double", "Float", "Boolean",
    "BigDecimal", "BigInteger", "List", "ArrayList", "LinkedList",
    "Set", "HashSet", "TreeSet", "Map", "HashMap", "TreeMap",
    "Queue", "Deque", "Stack", "Vector",
]

# Relation name -> (left text, right text) of a class-diagram edge.
EDGE_TEXT = {
    "extends": (" --|> ", ""),
    "implements": (" ..|> ", ""),
    "associates": (" --> ", ""),
    "uses": (" ..> ", " : uses"),
}

# Prompt wording.
PROMPT_HEAD = ("Query: ", "\n\nRelevant code contexts:\n")
PROMPT_TAIL = {
    "typed": "\nBased on the above code contexts, please provide an answer to the query:",
    "numbered": "\nBased on the above code snippets, please provide a detailed answer to the query.",
}

# Diagram fences.
FENCE_OPEN = "```mermaid"
FENCE_CLOSE = "```"

# Java words that can stand where a type or member name would.
MODIFIERS = [
    "public", "private", "protected", "static", "final", "abstract", "synchronized",
    "native", "strictfp", "default", "transient", "volatile", "sealed",
]
CONTROL_WORDS = ["if", "for", "while", "switch", "catch", "return", "new", "else", "throw"]


def english_stop_words() -> list[str]:
    """Spark's own English stop-word list (needs a running session)."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")
