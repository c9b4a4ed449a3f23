"""Word lists, tables, patterns and texts that results depend on."""

# --- fixed values: domains ---
ENTITY_TYPES = ("task", "method", "material", "metric", "other")
RELATION_TYPES = ("contains", "hierarchy", "implement", "use", "evaluate")
POSITIONS = ("introduction", "methodology", "experiment", "discussion")
CONFIDENCES = ("high", "medium", "low")
FUNCTIONS = ("background", "use", "compare", "inspire")
PATH_PATTERNS = (("task", "implement", "method"), ("method", "use", "material"), ("metric", "evaluate", "method"), ("task", "hierarchy", "task"), ("method", "hierarchy", "method"))

# --- fixed values: weights ---
TYPE_WEIGHTS = {"task": 0.25, "method": 0.35, "material": 0.20, "metric": 0.15, "other": 0.05}
FUSION_WEIGHTS = {"background": (0.9, 0.1), "use": (0.95, 0.05), "compare": (0.8, 0.2), "inspire": (0.7, 0.3)}
CONFIDENCE_SCORE = {"high": 1.0, "medium": 0.5, "low": 0.0}
VENUE_RANKS = {
    "nature": 1.0, "science": 1.0, "cell": 0.98, "lancet": 0.98, "nejm": 0.98, "neurips": 0.95, "nips": 0.95, "icml": 0.95, "iclr": 0.95, "aaai": 0.90, "ijcai": 0.90,
    "cvpr": 0.95, "iccv": 0.93, "eccv": 0.93, "acl": 0.92, "emnlp": 0.90, "naacl": 0.90, "osdi": 0.95, "sosp": 0.95, "usenix": 0.90, "sigmod": 0.93, "vldb": 0.93, "icde": 0.88,
    "pnas": 0.92, "plosone": 0.70, "arxiv": 0.50,
}

# --- fixed values: words ---
ENTITY_STOPWORDS = (
    "a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will would should could may might must can this "
    "that these those i you he she it we they what which who whom whose where when why how all each every both few more most other some such no nor not only own same "
    "so than too very just now"
).split()
TOPIC_STOPWORDS = (
    "the a an and or but in on at to for of with by from as is are was were be been being have has had do does did will would should could may might must can this that "
    "these those i you he she it we they what which who when where why how"
).split()
FUNCTION_WORDS = (("use", ("use", "utilize", "employ", "apply")), ("compare", ("compare", "comparison", "versus", "vs")), ("inspire", ("inspire", "motivate", "influence", "based on")))
ENTITY_WORDS = (
    ("method", ("algorithm", "approach", "method", "technique", "model", "system")),
    ("task", ("task", "problem", "challenge", "goal", "objective")),
    ("material", ("dataset", "data", "corpus", "benchmark")),
    ("metric", ("accuracy", "precision", "recall", "F1", "score", "performance")),
)
ABBREVIATIONS = (
    "Dr. Mr. Mrs. Ms. Prof. Ph.D. U.S.A. U.S. etc. e.g. i.e. vs. Inc. Ltd. Corp. St. Ave. Jan. Feb. Mar. Apr. Jun. Jul. Aug. Sep. Oct. Nov. Dec."
).split()

# --- fixed values: texts ---
FUNCTION_TEXTS = {
    "background": "Background citations provide context and establish the research foundation. Look for papers that introduce the research area, define key concepts, or provide theoretical background relevant to the query paper.",
    "use": "Use citations indicate that the query paper adopts or builds upon methods, techniques, or tools from the cited paper. Look for papers with similar methodologies, algorithms, or technical approaches that can be directly applied or extended.",
    "compare": "Compare citations involve comparing different approaches, methods, or results. Look for papers that address similar tasks but use different methods, allowing for meaningful comparison and evaluation.",
    "inspire": "Inspire citations refer to papers from different domains that provide novel ideas, concepts, or perspectives that can inspire new research directions. Look for papers with transferable ideas or cross-domain insights.",
}
DEFAULT_FUNCTION_TEXT = "General citation recommendation based on relevance and quality."
RANKED_CONFIDENCE = ("high", "high", "medium", "medium", "low")
RANKED_POSITION = ("introduction", "methodology", "methodology", "experiment", "discussion")
RANKED_REASON = (
    "This paper provides foundational background and theoretical framework relevant to the query paper's research domain.",
    "This paper presents a methodology that aligns with the query paper's approach and can be directly applied or extended.",
    "This paper offers experimental techniques and evaluation methods that complement the query paper's methodology.",
    "This paper demonstrates similar experimental setup and can serve as a comparison baseline for the query paper's results.",
    "This paper discusses related findings and implications that provide context for the query paper's contributions.",
)
BIO_LABELS = ("O", "B-Task", "I-Task", "B-Method", "I-Method", "B-Material", "I-Material", "B-Metric", "I-Metric", "B-Other", "I-Other")
