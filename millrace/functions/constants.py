"""Word lists, tables and limits that results depend on. Every rule takes them as parameters."""

# Retrieval budget by complexity: memories kept, history turns, candidate pool.
BUDGET = {"simple": (1, 2, 10), "normal": (2, 3, 15), "complex": (3, 5, 25), "deep": (5, 7, 40)}
# Weights of a memory's priority and source; what isn't listed counts 2 and 1.
PRIORITY = {"high": 3.0, "normal": 2.0, "low": 1.0, "excluded": 0.0}
SOURCE = {"chat": 1.0, "upload": 2.0, "manual": 3.0, "reflection": 3.0}
# Words that are never tags or topics.
TAG_STOPWORDS = """the and for are but not you all can her was one our out his has had him she they them this that with have
from your what when where which would could should about there their been were will just like than then into over very much
some more most only even also because while after before being does doing don't i'm i've it's that's really think know feel
want need make made going still every always never thing things something anything myself yourself how why who get got let""".split()
# Words that don't count as overlap between a message and the next.
OVERLAP_STOPWORDS = """the a an and or but if then so to of in on for with at by from up about into over after is are was were
be been being have has had do does did will would should could can i you he she it we they me my your our this that these
those what how why when who not no yes just get got like know think""".split()
# Phrases that mark depth and comparison.
DEPTH = ["i always", "i keep", "every time", "i realize", "i realise", "i notice", "pattern", "since childhood", "my father", "my mother", "growing up", "it's connected", "connected to", "i've never told", "i can't stop", "why do i", "same thing happened", "again and again", "deep down"]
COMPARISON = ["balance", "versus", " vs ", "trade off", "trade-off", "on one hand", "torn between", "both"]
# Sentiment terms; ties go to the label that stands first.
LEXICON = {
    "anxious": ["afraid", "anxious", "anxiety", "scared", "terrified", "nervous", "worried", "worry", "panic", "dread", "fear", "uneasy", "insecure", "what if", "can't sleep", "overwhelmed", "spiralling", "spiraling"],
    "negative": ["angry", "furious", "hate", "resent", "bitter", "betrayed", "sad", "depressed", "miserable", "hopeless", "exhausted", "drained", "broken", "failed", "failure", "guilty", "ashamed", "lonely", "grief", "hurt", "disappointed", "frustrated", "stuck", "quit"],
    "motivated": ["determined", "ready", "committed", "let's do", "lets do", "i will", "going to build", "excited to", "can't wait", "motivated", "driven", "focused", "all in", "double down", "ship it", "want to"],
    "positive": ["happy", "grateful", "thankful", "proud", "glad", "relieved", "great", "amazing", "wonderful", "love", "joy", "hopeful", "optimistic", "won", "landed", "closed the deal", "it worked"],
    "reflective": ["i realize", "i realise", "i notice", "i wonder", "thinking about", "looking back", "maybe i", "pattern", "makes me think", "understand why", "confused", "not sure why", "figured out", "it occurred to me"],
}
SENTIMENTS = ["positive", "neutral", "negative", "reflective", "anxious", "motivated"]
POSITIVE, NEGATIVE = ["positive", "motivated"], ["negative", "anxious"]
# Model labels by sentiment; the service's table has two more, the training table differs.
MODEL_LABELS = {
    "positive": ["joy", "love", "admiration", "optimism", "gratitude"], "negative": ["anger", "sadness", "disgust", "grief", "remorse"],
    "anxious": ["fear", "nervousness"], "reflective": ["surprise", "confusion", "realization", "curiosity"], "motivated": ["desire"], "neutral": ["neutral", "caring"],
}
SERVICE_EXTRA = {"approval": "positive", "annoyance": "negative"}
TRAINING_LABELS = {
    "positive": ["admiration", "amusement", "approval", "excitement", "joy", "love", "optimism", "pride", "relief", "gratitude"], "neutral": ["neutral", "caring", "curiosity"],
    "negative": ["anger", "annoyance", "disappointment", "disgust", "embarrassment", "grief", "remorse", "sadness"], "reflective": ["confusion", "realization", "surprise"],
    "anxious": ["fear", "nervousness"], "motivated": ["desire"],
}
# Crisis phrases, whole words, any case.
CRISIS = ["kill myself", "end my life", "take my own life", "suicidal?", "want to die", "better off dead", "no reason to live", "not worth living", "hurt myself", "harm myself", "cut myself"]
TOXIC = 0.85
# Scoring regexes and band of the evaluation.
FRAMEWORKS = r"(?i)\b(lean startup|product[- ]market fit|pmf|burn(?: rate)?|runway|first principles|unit economics|jobs[- ]to[- ]be[- ]done|jtbd|cac|ltv|churn|moat|traction|cohort)\b"
HEDGES = r"(?i)\b(maybe|perhaps|might consider|you could try|it depends|possibly|i'?m not sure|potentially)\b"
WORD_BAND = (150, 250)
# Advice as constructions, adverbs that hide them, and clauses that are exempt.
ADVICE = r"(?i)\b(?:you\s+should|you\s+need\s+to|you\s+ought\s+to|you\s+must|you\s+have\s+to|you\s+shouldn't|you\s+can't|you\s+should\s+not|my\s+advice|i\s+(?:would\s+)?(?:advise|suggest|recommend)|here'?s\s+what\s+(?:you\s+should|to)\s+do|(?:the\s+)?best\s+(?:thing|move)\s+(?:for\s+you\s+)?(?:would\s+be|is)|try\s+to\s+|make\s+sure\s+(?:you|to)|what\s+you\s+need\s+is)\b"
ADVERBS = r"(?i)\byou\s+(?:really|just|probably|actually|definitely|honestly|simply|truly|certainly|maybe|perhaps|also|still|now|only|literally|genuinely)\s+(should|need|must|have|ought|can|might|could|would)\b"
WH_CLAUSE = r"(?i)^\s*(?:and|but|so|yet)?\s*(?:what|how|why|who|whose|whom|where|when)\b"
COUNTERFACTUAL = r"(?i)\bshould\s*n(?:o|')?t?\s+have\b|\bshould\s+not\s+have\b"
# Verses by chapter, number words, and what makes a numeral a citation or a quantity.
VERSES = {1: 47, 2: 72, 3: 43, 4: 42, 5: 29, 6: 47, 7: 30, 8: 28, 9: 34, 10: 42, 11: 55, 12: 20, 13: 35, 14: 27, 15: 20, 16: 24, 17: 28, 18: 78}
CARDINALS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
TENS = "twenty thirty forty fifty sixty seventy".split()
TENTHS = "twentieth thirtieth fortieth fiftieth sixtieth seventieth".split()
CITE_CUE = r"(?i)\b(?:bhagavad|gita|bg|krishna|arjuna|chapters?|verses?|shlokas?|slokas?|tells|told|says|said|speaks|spoke|teaches|taught|warns|warned|reminds|counsels|as\s+it\s+is\s+written|draw\s+on)\b"
UNIT_AFTER = r"(?i)\s*(?:x\b|%|percent|per\s*cent|years?\b|yrs?\b|months?\b|weeks?\b|days?\b|hours?\b|hrs?\b|minutes?\b|mins?\b|seconds?\b|secs?\b|times\b|lakhs?\b|crores?\b|million\b|billion\b|[km]\b|rupees\b|dollars\b|met(?:re|er)s?\b|miles\b|kgs?\b|a\.?m\.?|p\.?m\.?|o'clock\b|ratio\b|odds\b|probability\b|out\s+of\b)"
LABEL_BEFORE = r"(?i)(?:version|ver\.?|\bv|section|clause|sec\.?|para|figure|fig\.?|table|score|rs\.?|inr|usd|no\.?|#|₹|\$)\s*$"
# Tokens of chat templates, and the template of a training text.
CHAT_TOKENS = ["<|eot_id|>", "<|end_of_text|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>"]
CHATML = "<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{user}<|im_end|>\n<|im_start|>assistant\n{assistant}<|im_end|>"
# Limits.
DUPLICATE, DUPLICATE_WINDOW, MAX_TAGS, MEMORY_FLOOR, MIN_MESSAGES = (3, 4), 200, 5, 80, 3
