"""Word lists, patterns, limits and formats that results depend on. Catalogues that grow are parameters."""

# Eastern digits, both ranges, and letters that count as one (from, to), position by position.
EASTERN_DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
LETTER_FOLDING = ("يىئكهۃةؤأإآ", "یییکہہہوااا")
URDU_PUNCTUATION = "[،؛؟۔]"
URDU_LETTERS = r"[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]"
ARABIC_TOKENS = r"[؀-ۿﭐ-﷿]"
MIXED_SHARE = 0.15

# Roman spelling: digraphs and letters that sound alike, applied in this order.
DIGRAPHS = (("ph", "f"), ("gh", "g"), ("kh", "k"), ("sh", "s"), ("ch", "c"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("ck", "k"), ("q", "k"), ("w", "v"), ("x", "ks"), ("z", "j"))

# A sound of fewer letters tells nothing; what kinds of words can be conditions; what parts words in a scan for terms.
LEAST_SOUND = 3
CONDITION_KINDS = ("condition", "symptom")
TERM_SEPARATORS = r"[\s,.;:()/–—-]+"

# Reference ranges that are words.
QUALITATIVE_RANGES = {
    "negative": "negative", "non reactive": "non-reactive", "non-reactive": "non-reactive", "nonreactive": "non-reactive", "not detected": "not detected",
    "absent": "absent", "nil": "absent", "normal": "normal", "reactive": "reactive", "positive": "positive",
}

# Texts that mean "no value" in extracted records, and words that mean true or false.
NULLISH = ("", "-", "--", "n/a", "na", "null", "undefined", "none", "nil", "unknown", "not mentioned", "not specified", "not available", "not provided")
TRUE_WORDS = ("true", "yes", "y", "1", "abnormal", "high", "low", "positive", "active")
FALSE_WORDS = ("false", "no", "n", "0", "normal", "negative", "inactive")
LANGUAGES = ("en", "ur", "mixed")

# Sections of a document, first match wins.
SECTIONS = (
    ("Medications", r"(?:medications?|medicines?|drugs?|prescriptions?|rx)\b"),
    ("Lab Results", r"(?:labs?|laboratory|test results|blood work|pathology|cbc|chemistry)\b"),
    ("Diagnosis", r"(?:diagnos(?:is|es|tic)|impression|assessment|conditions?)\b"),
    ("Allergies", r"(?:allerg(?:y|ies)|hypersensitivit)"),
    ("Vitals", r"(?:vitals?|blood pressure|temperature|pulse|heart rate)"),
    ("History", r"(?:history|anamnesis|chief complaint|presenting)"),
    ("Examination", r"(?:examinations?|physical exam|clinical exam|findings)"),
    ("Procedures", r"(?:procedures?|surger(?:y|ies)|operations?|interventions?)"),
    ("Discharge Summary", r"(?:discharge|summaries?|summary|disposition|follow.?up|plans?)"),
    ("Imaging", r"(?:imaging|radiology|x-rays?|ct scans?|mris?|ultrasounds?)"),
)
CHUNK_TOKENS, LEAST_BODY_TOKENS, LEAST_SLICE = 450, 50, 200

# Retrieval: candidates an arm, rank-fusion constant, floors, weights, half-life in days.
ARM_LIMIT, RRF_K, SIMILARITY_FLOOR, SIMILARITY_GAP, RECENCY_DAYS = 20, 60, 0.72, 0.08, 1095
WEIGHTS = {"rrf": 0.6, "coverage": 0.2, "recency": 0.12, "section": 0.08}
EXPANSION_LIMIT = 10
STOPWORDS = tuple(
    "a an the and or but if of in on at to for with my me i you your is am are was were be been do does did have has had "
    "what which who whom when where why how can could should would will shall may might any all some about from that this these those "
    "it its as there here please tell show give know get many much "
    "mujhe mera meri hai hain tha thi ka ki ke ko se kya kia kitna kitni aur".split()
)

# Words that the English text-search configuration leaves out.
ENGLISH_STOPS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once "
    "here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)

# Severities and priorities in rising order; statuses in the order in which one mention outranks another.
SEVERITIES = ("info", "mild", "moderate", "severe", "contraindicated")
STATUSES = ("present", "absent", "family", "hypothetical", "historical", "uncertain")
OWN_STATUSES = ("present", "historical", "uncertain")
CUE_REACH = 8

# Cues of a mention's status: pattern, status, and whether what follows or what precedes is meant; then what ends a cue's reach.
ASSERTION_CUES = (
    (r"\bno (?:evidence|sign|signs|history|complaints?|features?) of\b", "absent", "forward"),
    (r"\b(?:not|no|without|never had|denies|denied|denying|negative for|free of|absence of|ruled out for|nil)\b", "absent", "forward"),
    (r"\b(?:unremarkable|within normal limits|nad)\b", "absent", "backward"),
    (r"\b(?:was |were |is |are )?(?:ruled out|excluded|not detected|not seen|not found|negative)\b", "absent", "backward"),
    (r"(?:نہیں|کوئی نہیں|نفی)", "absent", "backward"),
    (r"\b(?:nahi|nahin|nahee|koi nahi)\b", "absent", "backward"),
    (r"\bfamily history(?: of)?\b", "family", "forward"),
    (
        r"\b(?:mother|father|brother|sister|sibling|siblings|parents?|grand(?:mother|father)|maternal|paternal|uncle|aunt|cousin)\b(?!\s+"
        r"(?:reports?|reported|says?|said|states?|stated|brought|brings?|tells?|told|mentions?|mentioned|describes?|described|complains?|complained|confirms?|confirmed|notes?|noted)\b)",
        "family",
        "forward",
    ),
    (r"\bruns in the family\b", "family", "backward"),
    (r"(?:والد|والدہ|بھائی|بہن|خاندانی|خاندان میں|ماں|باپ)", "family", "forward"),
    (r"\b(?:walid|walida|bhai|behan|khandani|ammi|abbu)\b", "family", "forward"),
    (r"\b(?:past (?:medical )?history|history of|h/o|previously|formerly|in the past|since childhood|resolved|no longer|recovered from|status post|s/p)\b", "historical", "forward"),
    (r"(?:ماضی میں|پہلے سے|پرانی)", "historical", "forward"),
    (r"\b(?:pehle|purani|purana|maazi)\b", "historical", "forward"),
    (r"\b(?:if|in case of|should you|should there be|watch for|return if|come back if|at risk of|risk for|may develop|to prevent|prophylaxis for|in the event of)\b", "hypothetical", "forward"),
    (r"(?:اگر|صورت میں)", "hypothetical", "forward"),
    (r"\b(?:agar|khuda na khasta)\b", "hypothetical", "forward"),
    (r"\b(?:possible|possibly|probable|probably|likely|suspected|suspicious for|question of|questionable|cannot (?:be )?exclude(?:d)?|rule out|r/o|differential|versus|vs\.?|to be confirmed|impression of)\b", "uncertain", "forward"),
    (r"(?:ممکن|شبہ|امکان)", "uncertain", "forward"),
    (r"\b(?:mumkin|shayad|shubah)\b", "uncertain", "forward"),
)
CUE_ENDS = r"\b(?:but|however|although|though|except|aside from|apart from|nevertheless|whereas|while|yet still)\b|(?:لیکن|مگر|البتہ)|\b(?:lekin|magar|albatta)\b"

# What a reader is told: of a mention's status (parts in order; term, because and quote are filled in), of one written both ways, of drug names, of what a record lacks.
STATUS_NOTES = {
    "absent": ('"', "term", '" was left out of your record because the document says you do not have it', "because", "quote", "."),
    "family": ('"', "term", '" was recorded as family history, not your own', "because", "quote", "."),
    "hypothetical": ('"', "term", '" appears as advice about what to do if it happens, not as something you have', "because", "quote", "."),
    "historical": ('"', "term", '" is recorded as past history rather than a current problem', "because", "."),
    "uncertain": ('"', "term", '" is written as a suspicion rather than a confirmed finding', "because", "."),
}
CONTRADICTION_NOTE = ('"', "term", '" is written both ways in this document — "', "denied", '" but also "', "asserted", '". It has been kept in your record but not as a confirmed finding. Please check with your doctor which is correct.')
DRUG_NOTE = ("These medicine names were read differently from how the RxNorm drug dictionary spells them: ", ". We kept what the document says and recorded the dictionary name alongside it — please check them against the original.")
MISSED_NOTE = ("Our medical language model also spotted these terms in the document that were not added to your health record: ", ". Please check the original and add anything that belongs.")
MOST_NOTES = 5

# What shows that a line is a prescription; dosages and frequencies as entities; conditions and tests known by name; model labels and what they are here.
DOSE_EVIDENCE = r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|µg|g|ml|iu|units?)\b"
FREQUENCY_EVIDENCE = r"\b(?:od|bd|bid|tds|tid|qid|qds|hs|sos|prn|stat|once|twice|thrice|daily|nightly|weekly|hourly|every\s+\d+\s*(?:hours?|days?))\b"
FORM_EVIDENCE = r"\b(?:tabs?|tablets?|caps?|capsules?|syp|syrup|susp|suspension|inj|injection|drops?|cream|ointment|sachet|inhaler|patch|supp|pessary)\b\.?"
ROUTE_EVIDENCE = r"\b(?:po|iv|im|sc|sl|pr|topical|oral(?:ly)?)\b"
DOSAGES = r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|µg|g|ml|iu|units?)\b"
FREQUENCIES = r"\b(?:od|bd|bid|tds|tid|qid|qds|hs|sos|prn|stat|once daily|twice daily|thrice daily|three times daily|four times daily|every \d+ hours?)\b"
KNOWN_CONDITIONS = (
    "diabetes", "diabetes mellitus", "type 2 diabetes", "type 1 diabetes", "hypertension", "high blood pressure", "hyperlipidemia", "dyslipidemia", "asthma", "copd", "tuberculosis", "tb", "pneumonia", "bronchitis",
    "anemia", "anaemia", "thalassemia", "hepatitis", "hepatitis b", "hepatitis c", "dengue", "malaria", "typhoid", "gastritis", "gerd", "ulcer", "hypothyroidism", "hyperthyroidism", "thyroid", "ckd", "chronic kidney disease",
    "uti", "urinary tract infection", "arthritis", "osteoarthritis", "migraine", "epilepsy", "depression", "anxiety", "obesity", "ischemic heart disease", "myocardial infarction", "heart failure", "stroke",
    "fatty liver", "cirrhosis", "jaundice", "polycystic ovary syndrome", "pcos",
)
KNOWN_LAB_TESTS = (
    "hba1c", "fasting blood sugar", "fbs", "random blood sugar", "rbs", "blood glucose", "creatinine", "urea", "bun", "egfr", "uric acid", "cbc", "hemoglobin", "haemoglobin", "hb", "wbc", "platelet", "platelets", "esr",
    "alt", "sgpt", "ast", "sgot", "alp", "bilirubin", "albumin", "cholesterol", "ldl", "hdl", "triglycerides", "lipid profile", "tsh", "t3", "t4", "ft4", "vitamin d", "vitamin b12", "ferritin",
    "crp", "d-dimer", "psa", "inr", "pt", "aptt", "sodium", "potassium", "calcium",
)
MODEL_LABELS = {
    "medication": "medication", "administration": "frequency", "dosage": "dosage", "frequency": "frequency", "duration": "frequency", "diagnostic_procedure": "lab_test", "lab_value": "lab_test",
    "disease_disorder": "condition", "sign_symptom": "condition", "biological_structure": "condition",
}
LEAST_MODEL_SCORE, MODEL_CHARS = 0.45, 1200

# Drug names: forms, strengths and frequencies that are not part of a name; endings that are; words with such an ending that are no drugs.
DRUG_FORMS = r"\b(?:tabs?|tablets?|caps?|capsules?|syp|syrup|susp|suspension|inj|injection|drops?|cream|ointment|sachet)\b\.?"
DRUG_STRENGTHS = r"\d+(?:\.\d+)?\s*(?:mg|mcg|µg|g|ml|l|iu|units?|%)"
DRUG_TIMES = r"\b(?:od|bd|bid|tds|tid|qid|qds|hs|sos|prn|stat|po|iv|im|sc)\b"
DRUG_ENDINGS = "cillin|mycin|micin|cycline|azole|azol|oxacin|floxacin|prazole|sartan|pril|olol|ipine|statin|metformin|glizide|gliptin|formin|dipine|semide|thiazide|parin|zepam|zolam|tidine|setron|profen|codone|caine|tinib|mab|nib"
NOT_DRUGS = tuple("april principal nostril tendril nonprofit domicile reconcile projectile juvenile infantile hydrocarbon carbon ribbon cocaine migraine romaine certain mountain fountain terminal criminal nominal seminal".split())
EDIT_SCORE, EDIT_SHARE = 8.0, 0.34

# Requests a window: scope, limit, seconds.
RATE_LIMITS = (
    ("upload", 20, 3600), ("reprocess", 10, 3600), ("chat", 30, 300), ("insights", 5, 3600), ("interactions", 20, 600), ("transcribe", 30, 3600), ("search", 60, 60),
    ("share", 20, 3600), ("confirmExtraction", 20, 3600), ("deleteAccount", 3, 3600), ("settings", 60, 3600), ("read", 300, 60), ("file", 120, 60),
)
STALL_MINUTES = 15
STALL_NOTE = 'Processing stopped unexpectedly and did not finish. Use "Reprocess" to try again.'

# Answers are kept for so many seconds, and so many of them.
ANSWER_SECONDS, ANSWERS_HELD = 300, 200

# Row caps of the history summary, and token budgets of a prompt.
HISTORY_CAPS = {"documents": 200, "medications": 60, "diagnoses": 60, "labs": 200, "allergies": 100}
PROMPT_TOKENS, TURN_TOKENS, DIGEST_TOKENS = 6000, 1200, 8000

# Waits between attempts in milliseconds, and the longest one that is waited out.
BACKOFF_MS = (1000, 4000, 10000)
LONGEST_WAIT_SECONDS = 45
