"""Word lists and maps of the text functions, as data. Lists are in alphabetical order unless order decides a result."""

from __future__ import annotations

QUOTES = {c: '"' for c in "“”„«»「」『』"} | {c: "'" for c in "‘’‚‹›"}
PUNCTUATION = {"…": "...", **dict.fromkeys("–—−", "-"), **dict.fromkeys("•·‧∙", "*"), "′": "'", "″": "''", "‴": "'''"}

#: What OCR makes of common words.
OCR_WORDS = {
    "and": "ancl anci arid", "that": "tiiat tliat tnat", "the": "tha tiie tlie tne", "there": "tiiere tliere tnere", "they": "tiiey tliey tney", "this": "tiiis tliis tnis",
    "through": "tiirough tlirough tnrough", "when": "wiien wlien wnen", "where": "wiiere wliere wnere", "which": "wiiich wliich wnich", "with": "widi witii witli",
}

STOPWORDS = tuple(
    "a am an and are as at be been being by can could did do does done for from had has have he how in is it its may might must of on shall should than that the their them then there these they this those to was were what when where who why will with would you your".split()
)
TOPIC_STOPWORDS = tuple(sorted({*STOPWORDS, *"all also any boy but don each get her his if just let man new no not now old only or own put same say see she so such too two use used using very way which".split()}))

#: In the order in which languages were listed: of equal scores the first found in the text wins, here the first listed.
LANGUAGE_WORDS = {
    "en": "a and are as for in is it of on that the to was with",
    "es": "da de el en es la le lo no que se su te un y",
    "fr": "avoir ce dans de en et il le pour que son un à être",
    "de": "auf das den der des die für im in ist mit sich und von zu",
    "it": "a al che con da del di e il in la le per si un",
    "pt": "a com da de do e em no não o os para um uma é",
    "ru": "а быть в и к как на не он она по с то это я",
    "zh": "一 上 不 个 中 为 了 人 和 在 大 是 有 的 这",
    "ja": "ある いる が さ し た て で と に の は も れ を",
    "ar": "أن أو إلى التي تكون على في كان كانت لا من هذا هذه يكون",
}
LANGUAGE_NAMES = {"en": "english", "es": "spanish", "fr": "french", "de": "german", "it": "italian", "pt": "portuguese", "ru": "russian", "zh": "chinese", "ja": "japanese", "ko": "korean", "ar": "arabic"}
#: In the order of the test; latin holds Cyrillic too and comes first, so Cyrillic text counts as latin.
SCRIPTS = {
    "latin": "a-zA-ZÀ-ÿĀ-žА-я", "cyrillic": "А-я", "arabic": "؀-ۿݐ-ݿࢠ-ࣿ", "chinese": "一-鿿", "japanese": "぀-ゟ゠-ヿ一-鿿",
    "korean": "가-힯ᄀ-ᇿ㄰-㆏", "devanagari": "ऀ-ॿ", "thai": "฀-๿", "hebrew": "֐-׿", "greek": "Ͱ-Ͽ",
}

POSITIVE = tuple(
    "admire advantage amazing appreciate approve awesome beautiful beneficial best better brilliant cheerful compliment congratulate delightful enjoy excellent excited fantastic first glad good grateful great happy helpful joy leading like love lovely magnificent nice optimistic outstanding perfect pleasant pleased positive praise premium quality recommend respect satisfied success successful superb superior thank thanks thrilled top triumph useful valuable victory win winner wonderful".split()
)
NEGATIVE = tuple(
    "abhor afraid against angry annoyed anxious attack awful bad barrier broken challenge concerned crisis damage danger defeat deny depressed despise detest difficulty disappointed disaster disgusting dishonest dislike emergency fail failure fake false fear fraud frustrated furious harm hate horrible hurt incorrect inferior irritated issue lie loathe lose loss low lying mad nervous obstacle oppose pain panic poor pressure problem refuse reject risk sad scam scared stress suffer terrible threat trouble unhappy upset victim warning weak worried worse worst wrong".split()
)
EMOTIONS = {
    word: emotion
    for emotion, words in {
        "anger": "angry annoyed frustrated furious irate irritated livid mad outraged rage",
        "anticipation": "eager excited expectant hopeful optimistic",
        "disgust": "appalled disgusted nauseated repulsed revolted sickened",
        "fear": "afraid alarmed anxious apprehensive frightened nervous panic scared terrified uneasy worried",
        "joy": "blissful cheerful content delighted elated euphoric glad happy joy pleased thrilled",
        "sadness": "dejected depressed gloomy melancholy miserable mournful sad sorrowful unhappy",
        "surprise": "amazed astonished astounded bewildered shocked startled stunned surprised",
        "trust": "confident dependable faithful reliable safe secure trust",
    }.items()
    for word in words.split()
}
INTENSIFIERS = {
    w: x
    for x, words in {0.5: "barely hardly scarcely", 0.7: "slightly", 0.8: "somewhat", 0.9: "almost nearly", 1.1: "rather", 1.2: "quite", 1.3: "really", 1.5: "very", 1.8: "completely totally", 2.0: "absolutely extremely incredibly"}.items()
    for w in words.split()
}
NEGATIONS = tuple("arent cannot cant couldnt didnt doesnt dont hadnt hasnt havent isnt lack lacking neither never no nobody none nor not nothing nowhere shouldnt wasnt werent without wont wouldnt".split())

#: Domain -> (keywords, pattern of words that count twice).
TAXONOMY = {
    domain: (tuple(keys.split("|")), pattern)
    for domain, keys, pattern in (
        ("technology", "ai|computer|machine learning|programming|software", "javascript|nodejs|python|react"),
        ("science", "analysis|data|experiment|research|study", "hypothesis|methodology|results"),
        ("business", "company|customer|market|revenue|strategy", "investment|loss|profit|roi"),
        ("education", "course|learn|student|teach|tutorial", "chapter|exercise|lesson"),
    )
}
COMPLETENESS = {
    "structure": ("finally", "first", "next", "second", "then", "third"), "examples": ("example", "for instance", "including", "such as"), "references": ("bibliography", "citation", "reference", "source"),
    "introduction": ("abstract", "introduction", "overview", "summary"), "conclusion": ("conclusion", "summary", "to summarize"),
}
PLACEHOLDERS = ("", "---", "n/a", "na", "none", "null", "tbd", "todo", "undefined", "xxx")
#: Price in dollars for 1,000 tokens, and the context in tokens.
MODELS = {"small-4k": (0.0015, 4096), "small-16k": (0.003, 16384), "large-8k": (0.03, 8192), "large-32k": (0.06, 32768), "long-100k": (0.008, 100000), "open-4k": (0.0, 4096)}
