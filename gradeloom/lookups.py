"""Fixed values shared by the prompt, extraction and failure expressions."""

# Names, texts and limits that must stay exactly as published so
# that prompts, labels and scores remain comparable with existing run logs.

DATASETS = ["gsm8k", "strategyqa"]

STRATEGIES = ["standard_few_shot", "zero_shot_cot", "persona_prompting"]

FEW_SHOT = {
    "gsm8k": [
        ("There are 15 trees in the grove. Grove workers will plant trees in the grove today. After they are done, there will be 21 trees. How many trees did the grove workers plant today?", "6"),
        ("If there are 3 cars in the parking lot and 2 more cars arrive, how many cars are in the parking lot?", "5"),
        ("Leah had 32 chocolates and her sister had 42. If they ate 35, how many pieces do they have left in total?", "39"),
        ("Jason had 20 lollipops. He gave Denny some lollipops. Now Jason has 12 lollipops. How many lollipops did Jason give to Denny?", "8"),
        ("Shawn has five toys. For Christmas, he got two toys each from his mom and dad. How many toys does he have now?", "9"),
    ],
    "strategyqa": [
        ("Do hamsters provide food for any animals?", "Yes"),
        ("Could a llama birth twice during War in Vietnam (1945-46)?", "No"),
        ("Would a pear sink in water?", "No"),
        ("Is the language used in Saint Vincent and the Grenadines rooted in English?", "Yes"),
        ("Did Aristotle use a laptop?", "No"),
    ],
}

TRIGGERS = {
    "default": "Let's think step by step.",
    "careful": "Let's solve this carefully.",
    "none": "",
}

STRUCTURED_TAILS = {
    "gsm8k": '\n\nWhen you are done reasoning, end your response with exactly one line of the form "Answer: <number>" (digits only, no units, no commas).',
    "strategyqa": '\n\nWhen you are done reasoning, end your response with exactly one line of the form "Answer: Yes" or "Answer: No".',
}

PERSONAS = {
    "gsm8k": {
        "original": "You are an advanced mathematician recognized for precise, logical calculations. Solve the following mathematical problem with absolute accuracy.",
        "revised": "You are a careful mathematician. Solve the problem with brief, numbered steps (no more than five). Do not restate the problem and do not add commentary.",
        "generic": "You are an expert. Solve the problem accurately.",
    },
    "strategyqa": {
        "original": "You are an advanced logician with deep general knowledge. Evaluate the following question and provide a logically sound answer.",
        "revised": "You are a careful reasoner. Use at most three short steps to decide the answer. Do not add background commentary.",
        "generic": "You are an expert. Answer the question accurately.",
    },
}

SWEEP_VALUES = {
    "max_tokens": [256, 512, 1024, 1500],
    "k_shot": [0, 1, 3, 5],
    "cot_trigger": ["default", "careful", "none"],
    "persona_variant": ["revised", "original", "generic"],
    "structured": [False, True],
}

DEFAULT_SWEEP = ["max_tokens", "structured"]

DEFAULT_MODEL = "nvidia/nemotron-3-super-120b-a12b"

BASE_CONDITION = {
    "model": DEFAULT_MODEL,
    "max_tokens": 1500,
    "k_shot": None,
    "cot_trigger": "default",
    "persona_variant": "revised",
    "structured": True,
    "temperature": 0.0,
    "self_consistency": 1,
}

CONTEXT_WINDOW = 16384
PROMPT_ROOM = 2048

PATH_SEPARATOR = " ||| "
LEGACY_CONDITION = "legacy"
MAX_TOKENS_HINT = 1500
LONG_COMPLETION_TOKENS = 240
LONG_TEXT_CHARS = 600
NUMERIC_TOLERANCE = 0.5
FAILURE_CATEGORIES = ["extraction", "reasoning", "truncation"]
CLEAN_ENDINGS = [".", "!", "?", '"', "'", ")", "]"]

# Patterns. Python's \w, \d and \s are Unicode-aware; these are the equivalents
# in Java regular expressions. Leading lookaheads only reject most positions fast.
WORD_CHAR = r"\p{L}\p{N}_"
SPACE_CHAR = r"\s\p{Z}\x{85}\x{1c}-\x{1f}"
WORD = rf"[{WORD_CHAR}]++"
NUMBER = r"(?=[-+\p{Nd}])[-+]?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?"
ANSWER_CUE = rf"(?iu)answer[{SPACE_CHAR}]*[:=]"
ANSWER_LINE = rf"{ANSWER_CUE}[{SPACE_CHAR}]*([^\n\r]+)"
NEAR_KEYWORD = rf"(?=[ats])(?:answer|total|therefore|so)[^\p{{Nd}}-]{{0,15}}({NUMBER})"
YES_NO_WORD = rf"(?=[yn])(?<![{WORD_CHAR}])(yes|no)(?![{WORD_CHAR}])"
FLOAT_TEXT = r"^[-+]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][-+]?\d+(?:_\d+)*)?$"
ANSWER_PUNCTUATION = ".!?, "
GOLD_MARK = "####"
