"""Word lists that decide which text matches count."""

# Words that never count as a match.
STOP_WORDS = [
    "who", "ourselves", "down", "only", "were", "him", "at", "weren't", "has", "few", "it's", "m", "again", "d",
    "haven", "been", "other", "we", "an", "own", "doing", "ma", "hers", "all", "haven't", "in", "but", "shouldn't",
    "does", "out", "aren", "you", "you'd", "himself", "isn't", "most", "y", "below", "is", "wasn't", "hasn", "them",
    "wouldn", "against", "this", "about", "there", "don", "that'll", "a", "being", "with", "your", "theirs", "its",
    "any", "why", "now", "during", "weren", "if", "should", "those", "be", "they", "o", "t", "of", "or", "me", "i",
    "some", "her", "do", "will", "yours", "for", "mightn", "nor", "needn", "the", "until", "couldn't", "he", "which",
    "yourself", "to", "needn't", "you're", "because", "their", "where", "it", "didn't", "ve", "whom", "should've",
    "can", "shan't", "on", "had", "have", "myself", "am", "don't", "under", "was", "won't", "these", "so", "as",
    "after", "above", "each", "ours", "hadn", "having", "wasn", "s", "doesn", "hadn't", "than", "by", "that", "both",
    "herself", "his", "wouldn't", "into", "doesn't", "before", "my", "won", "more", "are", "through", "same", "how",
    "what", "over", "ll", "yourselves", "up", "mustn", "mustn't", "she's", "re", "such", "didn", "you'll", "shan",
    "when", "you've", "themselves", "mightn't", "she", "from", "isn", "ain", "between", "once", "here", "shouldn",
    "our", "and", "not", "too", "very", "further", "while", "off", "couldn", "hasn't", "itself", "then", "did",
    "just", "aren't",
]

# Words that count only when the match is exact.
COMMON_WORDS = ["no", "yes", "many"]

# A term too common in databases to count.
DATABASE_TERMS = ["id"]

# Longer words that mark a two-valued column as a yes/no column.
LONG_BOOLEANS = ["male", "female"]
