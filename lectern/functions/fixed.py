"""Values fixed by the engine's contract: word lists, thresholds, patterns, policy tables."""

from __future__ import annotations

# Stop words of the lexical index
LEXICAL_STOP = (
    "about", "after", "again", "could", "from", "have", "into", "please", "should", "that", "their", "there", "these",
    "this", "what", "when", "where", "which", "with", "would", "your",
)

# Words that the evidence tokenizer drops
EVIDENCE_STOP = (
    "a", "about", "after", "all", "also", "an", "and", "answer", "any", "are", "as", "at", "be", "between",
    "by", "can", "course", "describe", "does", "do", "each", "explain", "for", "from", "has", "have", "how",
    "i", "in", "into", "is", "it", "its", "of", "on", "or", "our", "student", "students", "that", "the",
    "their", "them", "there", "these", "this", "those", "to", "use", "used", "using", "what", "when",
    "where", "which", "why", "with", "would", "you", "your", "statement", "guidance", "example",
)

# PostgreSQL's English stop words
FULL_TEXT_STOP = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of at by
for with about against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other some such no nor
not only own same so than too very s t can will just don should now""".split()
)

# Evidence words that say nothing about a need's subject
GENERIC_WORDS = (
    "definition", "define", "formula", "theorem", "rule", "method", "guidance", "worked", "exercise",
    "notation", "convention", "explanation", "prerequisite", "need", "show", "state", "how", "why",
    "choose", "course", "material", "concept", "idea", "step", "statement", "explain", "illustrate",
    "compare", "contrast", "relate", "related", "relation", "relationship", "describe", "identify", "list",
    "role", "mean", "meaning", "introduce", "introduced", "appear", "cover", "covered", "one", "two",
)

# Words that name no concept
LINK_STOP = (
    "calculu", "course", "material", "note", "say", "said", "actually", "official", "name", "answer", "wrong",
    "mark", "student", "differentiat", "explain", "mean", "sin", "cos", "tan", "sec", "dx", "dy", "du", "ln",
    "lim", "log", "exp", "sqrt", "pi", "inner", "one", "two", "get", "write", "wrote", "use", "used",
    "integral", "check", "state", "applied", "apply",
)

# Suffixes in the order in which they are tried
SUFFIXES = ("ations", "ation", "ings", "ing", "ies", "ed", "es", "s")

# Course-identity words that are ignored
IDENTITY_STOP = (
    "and", "the", "for", "with", "introduction", "introductory", "advanced", "course", "lecture", "notes", "class", "fall", "spring", "summer", "winter",
)

# Words that the topic fallback ignores
TOPIC_STOP = ("this", "that", "with", "from", "have", "will", "your", "into", "using")

# Headings and block openings, first match wins
CHAPTER = r"(?i)^\s*(?:chapter|ch\.?)\s+(\d+)[\s.:–\-]+(.{0,120})"
SECTION = r"^\s*(?:section\s+)?(\d+\.\d+(?:\.\d+)?)[\s.:–\-]+(.{0,120})"
BLOCK_OPENINGS = (
    (r"(?i)^\s*(?:definition|defn?)[\s.:]", "definition"),
    (r"(?i)^\s*theorem[\s.:]", "theorem"),
    (r"(?i)^\s*lemma[\s.:]", "theorem"),
    (r"(?i)^\s*corollary[\s.:]", "theorem"),
    (r"(?i)^\s*proposition[\s.:]", "theorem"),
    (r"(?i)^\s*example[\s.:]", "example"),
    (r"(?i)^\s*(?:exercise|problem|practice)[\s.:]", "exercise"),
    (r"(?i)^\s*proof[\s.:]", "proof"),
    (r"(?i)^\s*(?:remark|note|observation)[\s.:]", "remark"),
)
LABELLED = ("theorem", "definition", "example", "exercise", "proof", "remark", "formula", "solution")
BLOCK_CHARS = 1400

# Evidence markers by need type
MARKERS = {
    "definition": r"(?i)\b(is defined (as|by)|we say|is called|definition|denoted|means that|refers to)\b|\\begin\{definition\}|:=",
    "theorem_statement": r"(?i)\\begin\{(theorem|proposition|lemma|corollary)\}|\btheorem\b|\bstates that\b",
    "worked_example": r"(?i)\\begin\{example\}|\bexamples?\b|\be\.g\.|\bworked\b|\bfor instance\b|\bapplications?\b",
    "exercise": r"(?i)\\begin\{(exercise|problem)\}|\bexercises?\b|\bproblems?\b|\bpractice\b",
    "notation_convention": r"(?i)\bdenot|\bnotation\b|\bwritten as\b|\bwe write\b|\bsymbol\b",
}
FORMULA = r"[=^'/+*∫√]|\\[a-zA-Z]+|\d|[a-z]\(|−|-\s*\w"
MATH_ONE = {"−": "-", "–": "-", "′": "'", "·": "*", "×": "*", "⋅": "*"}
MATH_MANY = {"∫": "int", "²": "^2", "³": "^3", "√": "sqrt", "π": "pi", "θ": "theta", "∞": "infty", "≤": "<=", "≥": ">="}
CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"

# Markers of a student's turn
HELP_MARKERS = ("help", "stuck", "explain", "don't know", "do not know", "unsure", "hint", "show me", "what do i", "how do i", "i don't", "i do not", "not sure", "confused", "lost")
REASON_MARKERS = ("because", "therefore", "since", "so that", "which means", "thus", "hence", "that's why", "this means")
MATH_WORDS = ("integral", "derivative", "integrate", "differentiat", "substitut", "factor", "simplif", "expand", "solve", "calculat", "dx", "dy", "step", "approach", "method", "technique", "formula")
QUESTION_OPENINGS = ("what is ", "what are ", "how do ", "how does ", "can you ", "could you ", "define ", "what's the difference")

# Scope rules (pattern, decision, category, reason), first match wins
SCOPE_RULES = (
    (r"(?i)calculus\s+(ii|2|two)\b", "not_found", "outside_selected_scope", "another_course"),
    (r"(?i)second\s+semester", "needs_clarification", "ambiguous_scope", "ambiguous_course_part"),
    (r"(?i)\b(instructor|lecture)\b.*\b(say|said)\b|\b(say|said)\b.*\b(instructor|lecture)\b", "not_found", "source_unavailable", "no_lecture_record"),
)

# Grounding policy (action, mode, purposes, need types, excludes the current problem, engine only)
GROUNDING_POLICY = (
    ("elicit", "not_needed", [], [], False, False),
    ("inspect", "must_not", [], [], False, False),
    ("probe", "may", ["definition_lookup"], ["definition", "notation_convention"], False, False),
    ("diagnose", "may", ["diagnosis_support"], ["definition", "theorem_statement"], False, True),
    ("hint", "must", ["hint_support"], ["formula_statement", "method_guidance"], True, False),
    ("contrast", "must", ["example_lookup", "hint_support"], ["worked_example", "method_guidance"], True, False),
    ("demonstrate", "must", ["example_lookup"], ["worked_example"], True, False),
    ("explain", "must", ["answer_grounding", "prerequisite_review", "definition_lookup"], ["definition", "theorem_statement", "prerequisite_explanation"], False, False),
    ("retry", "not_needed", [], [], False, False),
    ("verify", "must_not", [], [], False, False),
    ("check_understanding", "may", ["practice_generation"], ["worked_example", "exercise"], True, False),
    ("transfer", "may", ["practice_generation"], ["exercise", "worked_example"], True, False),
)

# Purposes and need types of a request
PURPOSES = ("answer_grounding", "diagnosis_support", "hint_support", "citation_check", "definition_lookup", "example_lookup", "prerequisite_review", "practice_generation", "approach_grounding")
NEED_TYPES = ("formula_statement", "definition", "theorem_statement", "worked_example", "exercise", "method_guidance", "prerequisite_explanation", "notation_convention", "course_policy")

# Limits and weights
TOP_K, CONCEPT_BOOST = 4, 2.0
CANDIDATES, CONTEXT_CHARS, PER_FILE, FILE_FACTOR = 40, 12_000, 4, 0.95
RRF_K, RRF_WEIGHTS = 60, (1.0, 1.0, 1.4, 0.45)
#: Passages reserved for each sub-question.
PER_FACET = 2
MENTION_SHARE, RELATED_SHARE, JUDGE_COVERED, JUDGE_PARTIAL = 0.6, 0.3, 0.7, 0.35
LINK_SCORE, LINK_SINGLE_IDF, LINK_SECOND = 3.0, 2.5, 0.6
FORCE, SKIP = 0.7, 0.3
ACTIVITY_CHARS = 360
CONFIDENCE_RANK = {"low": 0, "medium": 1, "high": 3}

# Limits of a retrieval plan, texts of drafted needs, blocks that a need prefers
MAX_CONCEPTS, MAX_RELATED, MAX_NEEDS, DRAFT_NEEDS, MAX_NEED_CHARS, MAX_MAIN_CHARS, MENU = 3, 2, 4, 2, 200, 300, 40
NEED_QUERIES = {
    "definition": "definition of ", "theorem_statement": "statement of ", "formula_statement": "formula for ", "worked_example": "worked example using ", "exercise": "practice exercise on ",
    "method_guidance": "how to apply ", "prerequisite_explanation": "prerequisites needed for ", "notation_convention": "notation used for ", "course_policy": "course coverage of ",
}
PREFERRED_BLOCKS = {
    "definition": ("definition",), "theorem_statement": ("theorem",), "formula_statement": ("definition", "theorem"), "worked_example": ("example",), "exercise": ("exercise",),
    "method_guidance": ("remark", "example"), "prerequisite_explanation": ("definition", "remark"), "notation_convention": ("definition", "remark"), "course_policy": (),
}
MODEL_PURPOSES = ("answer_grounding", "diagnosis_support", "hint_support", "definition_lookup", "example_lookup", "prerequisite_review", "practice_generation")
TOOL_FIELDS = ("query", "purpose", "evidence_needs", "concept_id", "related_concept_ids", "contains_student_wording")
LEAK_PURPOSES = ("example_lookup", "practice_generation")

# Fields of course records
TOP_KEYS, TOP_OPTIONAL = ("course_context_schema_version", "Course", "Module", "Concept"), ("assumptions",)
RECORD_FIELDS = {
    "Course": ("id", "title", "level", "assumed_background", "module_ids"),
    "Module": ("id", "course_id", "title", "goal", "concept_ids"),
    "Concept": ("id", "module_id", "name", "summary", "prerequisite_ids", "difficulty_notes"),
}
MAY_BE_EMPTY, MUST_HOLD = ("prerequisite_ids", "difficulty_notes"), {"Course": "module_ids", "Module": "concept_ids"}
BLOOM, SOURCE_TYPES, PROVENANCE = ("remember", "understand", "apply", "analyze", "evaluate", "create"), ("syllabus", "textbook", "lecture_notes", "reading", "other"), ("source_backed", "ai_inferred")
NOTE_KEYS = ("misconception", "mitigation")
LINKED_FIELDS = ("user_id", "course_id", "session_id", "question_id", "turn_id", "attempt_id", "submission_id", "original_artifact_ref", "correlation_id")
TITLE_OPENINGS = ("this course", "course description", "course overview")

# Turn types of the specified engine, in the order in which they win; DISTRESS alone counts as HELP
TURN_ORDER = ("ANSWER", "PARTIAL", "NEW_QUESTION", "DEMAND", "CONCEPT", "HELP", "VAGUE", "ACK", "OFF_TOPIC", "DISTRESS", "INVALID")

# Ladders of cards by diagnosis
LADDERS = {
    "D0": ("ELICIT_START", "HINT_POINT", "HINT_TEACH", "DEMO_SIMILAR", "PREREQ_REVIEW", "PARK"),
    "D1": ("REVIEW_PROBLEM", "HINT_POINT", "HINT_TEACH", "DEMO_SIMILAR", "PARK"),
    "D2": ("PREREQ_CHECK", "PREREQ_REVIEW", "DEMO_SIMILAR", "PARK"),
    "D3": ("ASK_REASON", "HINT_TEACH", "DEMO_SIMILAR", "PREREQ_REVIEW", "PARK"),
    "D4": ("HINT_POINT", "HINT_TEACH", "DEMO_SIMILAR", "PREREQ_REVIEW", "PARK"),
    "D5": ("HINT_POINT", "HINT_TEACH", "DEMO_SIMILAR", "PREREQ_REVIEW", "PARK"),
    "D6": ("RETRY_CHECK", "HINT_POINT", "HINT_TEACH", "DEMO_SIMILAR", "PARK"),
    "D7": ("RETRY_CHECK", "HINT_POINT", "HINT_TEACH", "DEMO_SIMILAR", "PARK"),
    "UNCLEAR": ("ASK_WORK", "CLARIFY", "HINT_POINT", "HINT_TEACH", "PARK"),
}

# Cards (card, action, search, assists, disclosure)
CARDS = (
    ("ASK_WORK", "inspect", "blocked", False, "none"), ("ASK_REASON", "probe", "optional", False, "none"), ("CLARIFY", "probe", "optional", False, "none"), ("REVIEW_PROBLEM", "probe", "optional", False, "none"),
    ("PREREQ_CHECK", "probe", "optional", False, "none"), ("PREREQ_REVIEW", "explain", "required", True, "partial"), ("HINT_POINT", "hint", "optional", True, "partial"), ("HINT_TEACH", "hint", "required", True, "partial"),
    ("ANSWER_CONCEPT", "explain", "required", True, "partial"), ("RETRY_CHECK", "retry", "none", True, "partial"), ("CONFIRM_ASK_WHY", "check_understanding", "none", False, "partial"),
    ("ELICIT_START", "elicit", "none", False, "none"), ("RETRY_FULL", "retry", "none", False, "none"), ("REDIRECT", "elicit", "none", False, "none"), ("CONFIRM_SWITCH", "elicit", "none", False, "none"),
    ("NO_TARGET", "elicit", "none", False, "none"), ("DEMO_SIMILAR", "demonstrate", "none", True, "partial"), ("TRANSFER", "transfer", "none", False, "none"), ("WRAP_UP", "verify", "none", False, "full"),
    ("PARK", "verify", "none", False, "none"), ("SAFETY_STOP", "verify", "none", False, "none"),
)

# Phase transitions (phase, event, next phase, card)
TRANSITIONS = (
    ("ATTEMPTING", "correct", "SOLVED_CHECK", "CONFIRM_ASK_WHY"), ("REMEDIATING", "correct", "SOLVED_CHECK", "CONFIRM_ASK_WHY"), ("ATTEMPTING", "error", "REMEDIATING", "LADDER"), ("REMEDIATING", "error", "REMEDIATING", "LADDER"),
    ("REMEDIATING", "ladder_end", "PARKED", "PARK"), ("SOLVED_CHECK", "sound", "TRANSFER", "TRANSFER"), ("SOLVED_CHECK", "no_problem_left", "PARKED", "WRAP_UP"), ("SOLVED_CHECK", "weak", "SOLVED_CHECK", "CONFIRM_ASK_WHY"),
    ("SOLVED_CHECK", "contradicts", "REMEDIATING", "LADDER"), ("TRANSFER", "correct", "RESOLVED", "WRAP_UP"), ("TRANSFER", "correct_with_help", "SOLVED_CHECK", "CONFIRM_ASK_WHY"), ("TRANSFER", "error", "REMEDIATING", "LADDER"),
    ("TRANSFER", "second_error", "PARKED", "PARK"),
)

# Delivery results (result, text shown, code) to presentation status and failure class
DELIVERED = (
    ("PRESENTED", "presented", None), ("PARTIAL_TEXT", "partially_presented", None), ("PARTIAL", "failed", "transient"), ("RENDER_FAILED", "failed", "permanent"),
    ("FAILED", "failed", "transient"), ("REJECTED", "failed", "permanent"), ("CANCELLED", "failed", "transient"),
)

# Course numbers and terms as they are printed; words of a syllabus and of lecture notes, in a text and in a file's name
COURSE_NUMBER = r"(?i)\b(?:[a-z]{2}[.\s-]?)?\d{3}[.]\d{3}\b"
TERM = r"(?i)\b(?:fall|summer|winter|spring|fa|su|wi|sp|f|s|w)\s+20\d{2}\b"
SYLLABUS_WORDS, SYLLABUS_NAMES = ("syllabus", "course description", "grading", "office hours"), ("syllabus",)
NOTES_WORDS, NOTES_NAMES = ("lecture", "chapter", "theorem", "example", "definition"), ("note", "lecture", "chapter")

# What a removed citation label leaves behind, and what takes its place
LABEL_REMAINS = (
    (r"\[\s*,?\s*\]", ""), (r"\(\s*(?:see|cf\.?|e\.g\.,?)?\s*[,;]?\s*\)", ""), (r"(?:,\s*){2,}", ", "), (r"[ \t]+([,.;:!?])", "$1"),
    (r"(\b(?:in|see|from|and))\s*,", "$1"), (r",\s*(and|or)\b", " $1"), (r"[ \t]{2,}", " "),
)

# Where a text may offer an expression (between dollars, sums of function calls, sums of powers); the part behind = ends at these
CALL = r"(?:sin|cos|tan|log|exp|sqrt|ln)\s*\([^()]*\)"
OFFERED = (
    (r"\$\$?([^$]+)\$\$?", 1),
    (rf"(?i)[-a-zA-Z0-9*]*?{CALL}(?:\s*[+\-]\s*[-a-zA-Z0-9*]*?(?:{CALL}|[a-zA-Z0-9]+))*", 0),
    (r"[a-zA-Z]\s*(?:\*\*|\^)\s*[0-9]+(?:\s*[+\-*/]\s*[a-zA-Z0-9]+(?:\s*(?:\*\*|\^)\s*[0-9]+)?)*", 0),
)
OFFER_ENDS = r"[\n.;]"

# Notation of students and LaTeX, and the operators and calls it stands for
NOTATION = (
    (r"\s*\+\s*[Cc]\b\s*$", ""), (r"\\(cdot|times)", "*"), (r"\\ln", "log"), (r"\\(sin|cos|tan|log|exp)", "$1"), (r"\\frac\{([^{}]+)\}\{([^{}]+)\}", "($1)/($2)"),
    (r"\\[a-zA-Z]+", ""), (r"\{", "("), (r"\}", ")"), (r"\^", "**"), (r"([a-zA-Z\d])((?:sin|cos|tan|log|exp|sqrt)\()", "$1*$2"), (r"(\d)([a-zA-Z(])", "$1*$2"), (r"([a-zA-Z])(\d)", "$1*$2"),
)
