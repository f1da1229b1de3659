"""Fixed vocabularies and table schemas."""

# fixed values: entity types, relation types and decision relations of the graph
ENTITY_TYPES = ["PERSON", "COURSE", "DEPARTMENT", "COMMITTEE", "PROJECT", "RESOURCE", "EVENT", "DEADLINE", "POLICY", "TOPIC"]
RELATION_TYPES = ["teaches", "heads", "member_of", "assigned_to", "proposed", "approved", "rejected", "postponed", "deadline_for", "reports_to", "depends_on", "blocked_by", "discussed", "decided_on", "scheduled_for", "budget_for", "supervises", "enrolled_in", "part_of", "replaced_by"]
DECISION_RELATIONS = ["approved", "rejected", "decided_on", "postponed", "proposed", "assigned_to", "scheduled_for"]

# fixed values: the 37 dialogue relation labels, in head order, and the 17 kept ones
DIALOGUE_RELATIONS = [
    "gpe:births_in_place", "gpe:residents_of_place", "gpe:visitors_of_place", "org:employees_or_members", "org:students", "per:acquaintance", "per:age", "per:alternate_names", "per:alumni", "per:boss",
    "per:children", "per:client", "per:date_of_birth", "per:dates", "per:employee_or_member_of", "per:friends", "per:girl/boyfriend", "per:major", "per:negative_impression", "per:neighbor",
    "per:origin", "per:other_family", "per:parents", "per:pet", "per:place_of_birth", "per:place_of_residence", "per:place_of_work", "per:positive_impression", "per:roommate", "per:schools_attended",
    "per:siblings", "per:spouse", "per:subordinate", "per:title", "per:visited_place", "per:works", "unanswerable",
]
KEPT_RELATIONS = ["org:employees_or_members", "per:age", "per:alternate_names", "per:children", "per:employee_or_member_of", "per:friends", "per:girl/boyfriend", "per:negative_impression", "per:other_family", "per:parents", "per:pet", "per:positive_impression", "per:roommate", "per:spouse", "per:title", "per:visited_place", "per:works"]

# fixed values: default aliases, type-pair relations, tagger types
DEFAULT_ALIASES = {"cse": "Computer Science and Engineering", "ai&ml": "Artificial Intelligence and Machine Learning", "cse(ai&ml)": "CSE AI and ML", "ece": "Electronics and Communication Engineering", "mech": "Mechanical Engineering", "bos": "Board of Studies", "hod": "Head of Department"}
TYPE_PAIR_RELATIONS = [("PERSON", "DEPARTMENT", "member_of"), ("PERSON", "COURSE", "teaches"), ("PERSON", "COMMITTEE", "member_of"), ("PERSON", "PERSON", "discussed_with"), ("DEPARTMENT", "COURSE", "offers"), ("PERSON", "EVENT", "participates_in"), ("PERSON", "PROJECT", "assigned_to")]
TAGGER_TYPES = {"PERSON": "PERSON", "ORG": "DEPARTMENT", "DATE": "DEADLINE", "TIME": "DEADLINE", "GPE": "RESOURCE", "FAC": "RESOURCE", "EVENT": "EVENT", "WORK_OF_ART": "COURSE"}

# fixed values: phrases of an answer that declines to answer
NON_ANSWERS = ["not specified", "not mentioned", "does not specify", "does not explain", "does not contain", "no information", "not provided", "couldn't find", "could not find", "unable to", "not available", "does not indicate", "doesn't specify", "no relevant", "not enough information"]

# fixed values: patterns
PLACEHOLDER = r"(?i)^SPEAKER[_ ]?\d+$"
NODE_LABEL = r"^[A-Z][A-Z_]{0,30}$"
TITLE = r"(?i)^(dr\.?|prof\.?|professor|mr\.?|mrs\.?|ms\.?|sir|madam)\s+"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"

# fixed values: the scoring block of a pre-registration: section, blanks, conditions, and each key with its kind, words and least and greatest number (none)
SCORING_SECTION = "rq3-scoring"
BLANKS = ["____", "YYYY-MM-DD"]
SCORED_CONDITIONS = ["teacher_I", "perm_I", "rand_I", "gold_I"]
SCORING_KEYS = [
    ("line10_gold_I_minus_gold", "number", None, None, None), ("line10_gold_I_real", "flag", None, None, None), ("line10_gold_sub_minus_gold", "number", None, None, None), ("line10_ratio", "number", None, None, None),
    ("line11", "word", ["lower", "higher", "same"], None, None), ("line12", "word", ["lower", "higher", "same"], None, None),
    ("line13", "partly", ["holds", "fails"], None, None), ("line13_controls", "word", ["not_real", "not_real_positive"], None, None),
    ("line14_pct", "number", None, None, None), ("line14_expect", "word", ["holds", "fails"], None, None), ("line15_pp", "number", None, None, None), ("line15_expect", "word", ["holds", "fails"], None, None),
    ("line17_pct", "number", None, None, None), ("line17_expect", "word", ["holds", "fails"], None, None),
]

# fixed value: the version of the labelling prompt
PROMPT_VERSION = "v2"

# fixed values: thresholds and training settings
SECONDS_PER_TURN, WINDOW, OVERLAP, ROW_CAP, MAX_ATTEMPTS = 4.0, 15, 5, 200, 3
FUZZY, REAL_DIFFERENCE, DIAGONAL_WARNING = 0.85, 0.03, 0.15
MIN_EXAMPLES, MIN_SHARE, MIN_CLASSES, MEMORY = 15, 0.15, 3, 10
TRAINING = {"lr": 1e-3, "weight_decay": 0.0, "batch": 32, "epochs": 120, "patience": 5, "seeds": (1234, 1, 2), "hidden": 256, "dropout": 0.2, "tau": 0.5, "gamma": 2.0, "lambda": 0.7, "beta": 0.2, "fixed_epochs": 10}

# table schemas, as DDL
UTTERANCES = "meeting_id STRING, seq INT, speaker_id STRING, text STRING, start_time DOUBLE, end_time DOUBLE"
TRIPLES = "mention_seq BIGINT, subject STRING, subject_type STRING, relation STRING, object STRING, object_type STRING, confidence DOUBLE, source_meeting STRING, timestamp DOUBLE, source_utterance STRING, deadline_date STRING, window_text STRING"
RESPONSE = "triples ARRAY<STRUCT<subject STRING, subject_type STRING, relation STRING, object STRING, object_type STRING, confidence STRING, utterance_time STRING, deadline_date STRING>>"
PAIRS = "dialogue_id STRING, pair_index INT, x STRING, x_type STRING, y STRING, y_type STRING, gold_relations ARRAY<STRING>, trigger STRING"
R_LONG = "run_id STRING, metric STRING, t INT, j INT, v DOUBLE"
