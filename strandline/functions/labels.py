"""Score dimensions and their polarity groups."""

# The label set of the scored series and its polarity groups.
LABELS = [
    "admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion",
    "curiosity", "desire", "disappointment", "disapproval", "disgust", "embarrassment",
    "excitement", "fear", "gratitude", "grief", "joy", "love", "nervousness", "optimism",
    "pride", "realization", "relief", "remorse", "sadness", "surprise", "neutral",
]
POSITIVE = [
    "admiration", "amusement", "approval", "caring", "excitement", "gratitude", "joy",
    "love", "optimism", "pride", "relief",
]
NEGATIVE = [
    "anger", "annoyance", "disappointment", "disapproval", "disgust", "embarrassment",
    "fear", "grief", "nervousness", "remorse", "sadness",
]
AMBIGUOUS = ["confusion", "curiosity", "desire", "realization", "surprise", "neutral"]
WIDE_POSITIVE = sorted(POSITIVE + ["desire"])
WIDE_NEGATIVE = sorted(NEGATIVE + ["confusion"])
INTENSITY = ["joy", "fear", "anger", "love", "sadness"]
TOP_SEVEN = ["joy", "sadness", "fear", "anger", "love", "excitement", "neutral"]


def columns(labels: list[str], prefix: str = "emotion_") -> list[str]:
    """Column names of the given labels."""
    return [prefix + label for label in labels]
