"""Word lists and limits. They must equal the published definitions for right results."""

from __future__ import annotations

# Text markers left behind by deleted or moderated posts.
INVALID_MARKERS = ["[deleted]", "[removed]"]

# Hedging phrases counted as substrings of the lower-cased text.
HEDGING_PHRASES = [
    "it seems", "it appears", "perhaps", "arguably", "it's worth noting",
    "it is worth noting", "in my opinion", "i think", "i believe", "i feel",
    "to be fair", "that said", "having said that", "on the other hand",
    "it could be", "it might be", "it may be", "one could argue",
    "it's important to", "it is important to", "it's interesting to",
    "it is interesting to", "generally speaking", "for what it's worth",
    "in general", "overall", "essentially", "fundamentally", "basically",
    "in essence", "at the end of the day", "when it comes to",
    "there are several", "there are many", "there are a few",
]

# First-person words.
FIRST_PERSON = ["i", "me", "my", "mine", "myself", "i'm", "i've", "i'd", "i'll"]

# The part-of-speech tags that become features.
POS_TAGS = [
    "NN", "NNS", "NNP", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "JJ", "JJR", "JJS",
    "RB", "RBR", "RBS", "PRP", "DT", "IN", "CC",
]

# Tags counted as formal and informal by the formality score.
FORMAL_TAGS = ["NN", "NNS", "NNP", "JJ", "JJR", "JJS", "IN", "DT"]
INFORMAL_TAGS = ["VB", "VBD", "VBG", "RB", "RBR", "PRP"]

# Common English stop words.
STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]

# Closed-class words with the tag they nearly always carry; open classes follow from suffixes.
WORD_TAGS = {
    "DT": ["the", "a", "an", "this", "that", "these", "those", "each", "every", "some", "any", "no"],
    "IN": ["of", "in", "on", "at", "by", "for", "with", "from", "as", "if", "about", "into", "than",
           "because", "through", "after", "before", "over", "under", "between", "while"],
    "CC": ["and", "or", "but", "nor", "yet"],
    "PRP": ["i", "you", "he", "she", "it", "we", "they", "me", "him", "us", "them", "myself"],
    "VBZ": ["is", "has", "does"],
    "VBP": ["am", "are", "have", "do"],
    "VBD": ["was", "were", "had", "did", "said"],
    "VB": ["be", "make", "take", "go", "get"],
    "RB": ["not", "very", "so", "too", "also", "just", "never", "always", "now", "then", "here"],
    "RBR": ["less"],
    "RBS": ["least"],
    "JJR": ["more", "better", "worse"],
    "JJS": ["most", "best", "worst"],
    "JJ": ["good", "bad", "new", "old", "great", "other", "many"],
}

# Suffix rules tried in this order for words outside WORD_TAGS.
SUFFIX_TAGS = [
    ("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("est", "JJS"), ("able", "JJ"), ("ible", "JJ"),
    ("ous", "JJ"), ("ful", "JJ"), ("ive", "JJ"), ("al", "JJ"), ("ic", "JJ"), ("en", "VBN"),
    ("ss", "NN"), ("s", "NNS"),
]

# A small valence lexicon on the usual -4..4 scale; callers with a fuller one pass it in.
VALENCE = {
    "good": 1.9, "great": 3.1, "love": 3.2, "like": 1.5, "best": 3.2, "better": 1.9, "nice": 1.8,
    "happy": 2.7, "excellent": 2.7, "amazing": 2.8, "awesome": 3.1, "fun": 2.3, "thanks": 1.9,
    "help": 1.7, "interesting": 1.7, "beautiful": 2.9, "win": 2.8, "hope": 1.9, "agree": 1.5,
    "bad": -2.5, "worse": -2.1, "worst": -3.1, "hate": -2.7, "terrible": -2.1, "awful": -2.0,
    "sad": -2.1, "angry": -2.3, "wrong": -2.1, "problem": -1.7, "fail": -2.5, "stupid": -2.4,
    "ugly": -2.3, "boring": -1.3, "fear": -2.2, "kill": -3.7, "war": -2.9, "pain": -2.3,
    "lose": -1.7, "poor": -2.1, "error": -1.7,
}

# Words of the sentiment rules: what strengthens (+) or weakens (-) the next words, turns them round, or sets parts off.
BOOSTERS = {
    "very": 0.293, "really": 0.293, "extremely": 0.293, "so": 0.293, "totally": 0.293, "absolutely": 0.293, "quite": 0.293,
    "most": 0.293, "more": 0.293, "slightly": -0.293, "somewhat": -0.293, "barely": -0.293, "hardly": -0.293, "almost": -0.293,
    "less": -0.293, "partly": -0.293,
}
NEGATIONS = [
    "not", "no", "never", "none", "nothing", "neither", "nor", "without", "cannot", "can't", "don't", "doesn't", "didn't",
    "won't", "isn't", "aren't", "wasn't", "weren't", "shouldn't", "wouldn't", "couldn't", "hasn't", "haven't", "hadn't",
]
CONTRASTS = ["but"]

# Request limits of the embedding batcher and the per-minute token budget.
MAX_TOKENS_PER_REQUEST = 250_000
MAX_ROWS_PER_REQUEST = 1_000
MAX_TOKENS_PER_TEXT = 8_191
TOKENS_PER_MINUTE = 900_000
LONG_TEXT_CHUNK = 2_000
ENCODED_LENGTH = 256
EMBEDDING_DIM = 384

# Labels: 0 is an automated agent, 1 is a human, everywhere.
CLASS_NAMES = {0: "agent", 1: "human"}
