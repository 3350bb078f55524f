"""Word lists, tags and patterns as resources.

Everything in this module is a fixed value: results are right only with these very values.
"""

from __future__ import annotations

#: Verbs that add nothing beside another verb.
LIGHT_VERBS = (
    "can", "will", "shall", "may", "could", "would", "should", "has", "are", "is", "have", "was", "were", "had", "do", "does", "did",
    "am", "be", "being", "been", "get", "got", "gets", "getting", "gotten", "make", "makes", "made", "making", "let", "lets", "letting",
)

#: English stop words.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should",
    "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn", "didn't", "doesn",
    "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't",
    "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
)

#: Part-of-speech tags that a subject, and an object, may have.
SUBJECT_TAGS = ("NN", "NNS", "NNP", "NNPS")
OBJECT_TAGS = ("NN", "NNS", "NNP", "NNPS", "VBG", "JJ", "JJR", "JJS", "VB", "VBD", "VBN", "VBP", "VBZ")

#: Citations: a year or a number in brackets, with plain text before or after a year.
CITATION = r"""\[[0-9]{4}[a-zA-Z0-9 .,!/\-"']*\]|\[[0-9]+\]|\[[a-zA-Z0-9 .,!/\-"']*[0-9]{4}\]|\([a-zA-Z0-9 .,!/\-"']*[0-9]{4}\)|\([0-9]{4}[a-zA-Z0-9 .,!/\-"']*\)|\([0-9]+\)"""

#: ASCII punctuation, as the inside of a character class.
PUNCTUATION = r"!-/:-@\[-`{-~"
