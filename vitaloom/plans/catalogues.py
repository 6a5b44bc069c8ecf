"""Default catalogues: parameters of the linking operators. Larger ones come as tables of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Query words and what they add.
SYNONYMS = {
    "sugar": ["glucose", "hba1c", "blood sugar", "diabetes"],
    "blood pressure": ["bp", "systolic", "diastolic", "hypertension"],
    "hba1c": ["glycated hemoglobin", "a1c", "blood sugar"],
    "cholesterol": ["lipid profile", "ldl", "hdl", "triglycerides"],
    "thyroid": ["tsh", "t3", "t4"],
    "kidney function": ["creatinine", "urea", "egfr", "rft"],
}

# Key, display name, loinc, canonical unit, factors to it, synonyms. Uric acid has no loinc here: it was given urea's.
ANALYTES = (
    ("hba1c", "HbA1c", "4548-4", "%", {"%": 1.0, "percent": 1.0}, ["hba1c", "hb a1c", "a1c", "glycated hemoglobin", "glycated haemoglobin", "glycosylated hemoglobin", "glycosylated haemoglobin", "haemoglobin a1c", "hemoglobin a1c"]),
    ("glucose_fasting", "Fasting blood glucose", "1558-6", "mg/dL", {"mg/dl": 1.0, "mg%": 1.0, "mmol/l": 18.0182}, ["fasting blood sugar", "fbs", "fasting glucose", "fasting blood glucose", "blood sugar fasting", "bsf", "glucose fasting", "sugar fasting"]),
    ("glucose_random", "Random blood glucose", "2345-7", "mg/dL", {"mg/dl": 1.0, "mg%": 1.0, "mmol/l": 18.0182}, ["random blood sugar", "rbs", "random glucose", "blood sugar random", "bsr", "glucose random", "rbg"]),
    ("creatinine", "Creatinine", "2160-0", "mg/dL", {"mg/dl": 1.0, "umol/l": 1 / 88.4, "mmol/l": 1000 / 88.4}, ["creatinine", "s creatinine", "serum creatinine", "cr", "creat"]),
    ("urea", "Urea", "3084-1", "mg/dL", {"mg/dl": 1.0, "mmol/l": 6.006}, ["urea", "blood urea", "serum urea", "bun", "blood urea nitrogen"]),
    ("egfr", "eGFR", "33914-3", "mL/min/1.73m²", {}, ["egfr", "gfr", "estimated gfr", "estimated glomerular filtration rate"]),
    ("uric_acid", "Uric acid", None, "mg/dL", {"mg/dl": 1.0, "umol/l": 1 / 59.48}, ["uric acid", "serum uric acid", "urate"]),
    ("hemoglobin", "Hemoglobin", "718-7", "g/dL", {"g/dl": 1.0, "gm/dl": 1.0, "g/l": 0.1, "gms/dl": 1.0}, ["hemoglobin", "haemoglobin", "hb", "hgb", "hb%", "haemoglobin hb"]),
    ("wbc", "White cell count", "6690-2", "10^9/L", {"10^9/l": 1.0, "x10^9/l": 1.0, "10^3/ul": 1.0, "k/ul": 1.0, "/ul": 0.001, "cumm": 0.001, "/cumm": 0.001}, ["wbc", "white blood cells", "white cell count", "tlc", "total leucocyte count", "total leukocyte count", "leucocyte count"]),
    ("platelets", "Platelets", "777-3", "10^9/L", {"10^9/l": 1.0, "x10^9/l": 1.0, "10^3/ul": 1.0, "lakh/cumm": 10.0, "/ul": 0.001, "cumm": 0.001, "/cumm": 0.001}, ["platelets", "platelet count", "plt", "thrombocyte count"]),
    ("esr", "ESR", "4537-7", "mm/hr", {}, ["esr", "erythrocyte sedimentation rate", "sed rate"]),
    ("alt", "ALT (SGPT)", "1742-6", "U/L", {"u/l": 1.0, "iu/l": 1.0, "units/l": 1.0}, ["alt", "sgpt", "alanine aminotransferase", "alt sgpt", "sgpt alt"]),
    ("ast", "AST (SGOT)", "1920-8", "U/L", {"u/l": 1.0, "iu/l": 1.0, "units/l": 1.0}, ["ast", "sgot", "aspartate aminotransferase", "ast sgot", "sgot ast"]),
    ("alp", "Alkaline phosphatase", "6768-6", "U/L", {"u/l": 1.0, "iu/l": 1.0}, ["alp", "alkaline phosphatase", "alk phos"]),
    ("bilirubin_total", "Total bilirubin", "1975-2", "mg/dL", {"mg/dl": 1.0, "umol/l": 1 / 17.1}, ["bilirubin", "total bilirubin", "bilirubin total", "s bilirubin", "serum bilirubin"]),
    ("albumin", "Albumin", "1751-7", "g/dL", {"g/dl": 1.0, "g/l": 0.1}, ["albumin", "serum albumin", "s albumin"]),
    ("cholesterol_total", "Total cholesterol", "2093-3", "mg/dL", {"mg/dl": 1.0, "mmol/l": 38.67}, ["cholesterol", "total cholesterol", "cholesterol total", "s cholesterol"]),
    ("ldl", "LDL cholesterol", "2089-1", "mg/dL", {"mg/dl": 1.0, "mmol/l": 38.67}, ["ldl", "ldl cholesterol", "ldl c", "low density lipoprotein"]),
    ("hdl", "HDL cholesterol", "2085-9", "mg/dL", {"mg/dl": 1.0, "mmol/l": 38.67}, ["hdl", "hdl cholesterol", "hdl c", "high density lipoprotein"]),
    ("triglycerides", "Triglycerides", "2571-8", "mg/dL", {"mg/dl": 1.0, "mmol/l": 88.57}, ["triglycerides", "triglyceride", "tg", "tgl"]),
    ("tsh", "TSH", "3016-3", "mIU/L", {"miu/l": 1.0, "uiu/ml": 1.0, "miu/ml": 1000.0}, ["tsh", "thyroid stimulating hormone", "thyrotropin"]),
    ("ft4", "Free T4", "3024-7", "ng/dL", {}, ["ft4", "free t4", "free thyroxine", "t4 free"]),
    ("t3", "T3", "3053-6", "ng/dL", {}, ["t3", "triiodothyronine", "total t3"]),
    ("t4", "T4", "3026-2", "µg/dL", {}, ["t4", "thyroxine", "total t4"]),
    ("vitamin_d", "Vitamin D (25-OH)", "1989-3", "ng/mL", {"ng/ml": 1.0, "nmol/l": 1 / 2.496}, ["vitamin d", "vit d", "25 oh vitamin d", "25 hydroxy vitamin d", "vitamin d3", "vitamin d 25 oh"]),
    ("vitamin_b12", "Vitamin B12", "2132-9", "pg/mL", {"pg/ml": 1.0, "pmol/l": 1 / 0.7378}, ["vitamin b12", "vit b12", "b12", "cobalamin"]),
    ("ferritin", "Ferritin", "2276-4", "ng/mL", {"ng/ml": 1.0, "ug/l": 1.0}, ["ferritin", "serum ferritin"]),
    ("crp", "CRP", "1988-5", "mg/L", {"mg/l": 1.0, "mg/dl": 10.0}, ["crp", "c reactive protein", "hs crp", "high sensitivity crp"]),
    ("sodium", "Sodium", "2951-2", "mmol/L", {"mmol/l": 1.0, "meq/l": 1.0}, ["sodium", "na", "serum sodium", "s sodium"]),
    ("potassium", "Potassium", "2823-3", "mmol/L", {"mmol/l": 1.0, "meq/l": 1.0}, ["potassium", "k", "serum potassium", "s potassium"]),
    ("calcium", "Calcium", "17861-6", "mg/dL", {"mg/dl": 1.0, "mmol/l": 4.008}, ["calcium", "serum calcium", "s calcium", "total calcium"]),
    ("inr", "INR", "6301-6", None, {}, ["inr", "international normalized ratio", "international normalised ratio"]),
)

# Code, canonical name, aliases.
CONDITIONS = (
    ("E11.9", "Type 2 diabetes mellitus", ["type 2 diabetes", "diabetes mellitus type 2", "t2dm", "dm type 2", "dm2", "niddm", "diabetes", "diabetes mellitus", "dm"]),
    ("E10.9", "Type 1 diabetes mellitus", ["type 1 diabetes", "diabetes mellitus type 1", "t1dm", "dm type 1", "iddm", "juvenile diabetes"]),
    ("O24.419", "Gestational diabetes", ["gdm", "diabetes in pregnancy"]),
    ("R73.03", "Prediabetes", ["impaired glucose tolerance", "igt", "impaired fasting glucose"]),
    ("E16.2", "Hypoglycemia", ["low blood sugar", "hypoglycaemia"]),
    ("E03.9", "Hypothyroidism", ["underactive thyroid", "hypothyroid"]),
    ("E05.90", "Hyperthyroidism", ["thyrotoxicosis", "overactive thyroid", "hyperthyroid", "graves disease"]),
    ("E04.9", "Goiter", ["goitre", "thyroid swelling"]),
    ("E78.5", "Hyperlipidemia", ["dyslipidemia", "high cholesterol", "hypercholesterolemia", "raised lipids", "hyperlipidaemia"]),
    ("E28.2", "Polycystic ovary syndrome", ["pcos", "pcod", "polycystic ovarian disease"]),
    ("E66.9", "Obesity", ["overweight", "raised bmi"]),
    ("E55.9", "Vitamin D deficiency", ["low vitamin d", "hypovitaminosis d"]),
    ("E53.8", "Vitamin B12 deficiency", ["b12 deficiency", "low b12", "cobalamin deficiency"]),
    ("I10", "Hypertension", ["high blood pressure", "htn", "raised blood pressure", "essential hypertension", "high bp"]),
    ("I25.10", "Coronary artery disease", ["cad", "ischemic heart disease", "ihd", "ischaemic heart disease"]),
    ("I21.9", "Acute myocardial infarction", ["heart attack", "mi", "myocardial infarction", "stemi", "nstemi"]),
    ("I20.9", "Angina pectoris", ["angina", "chest pain on exertion"]),
    ("I50.9", "Heart failure", ["ccf", "chf", "congestive cardiac failure", "cardiac failure"]),
    ("I48.91", "Atrial fibrillation", ["af", "afib", "a fib"]),
    ("I63.9", "Stroke", ["cva", "cerebrovascular accident", "cerebral infarction", "brain attack"]),
    ("J45.909", "Asthma", ["bronchial asthma", "reactive airway disease"]),
    ("J44.9", "Chronic obstructive pulmonary disease", ["copd", "chronic bronchitis emphysema", "cold lung disease"]),
    ("J18.9", "Pneumonia", ["chest infection", "lower respiratory tract infection", "lrti"]),
    ("J40", "Bronchitis", ["acute bronchitis"]),
    ("J01.90", "Acute sinusitis", ["sinusitis", "sinus infection"]),
    ("J30.9", "Allergic rhinitis", ["hay fever", "nasal allergy"]),
    ("A15.0", "Pulmonary tuberculosis", ["tb", "ptb", "tuberculosis", "koch disease", "pulmonary tb"]),
    ("U07.1", "COVID-19", ["covid", "sars cov 2", "corona"]),
    ("A01.00", "Typhoid fever", ["typhoid", "enteric fever"]),
    ("B54", "Malaria", ["plasmodium infection"]),
    ("A90", "Dengue fever", ["dengue", "breakbone fever"]),
    ("A09", "Gastroenteritis", ["stomach infection", "food poisoning", "infectious diarrhea", "loose motions"]),
    ("B18.1", "Chronic hepatitis B", ["hepatitis b", "hbv", "hbsag positive"]),
    ("B18.2", "Chronic hepatitis C", ["hepatitis c", "hcv", "anti hcv positive"]),
    ("B15.9", "Hepatitis A", ["hav"]),
    ("N18.9", "Chronic kidney disease", ["ckd", "chronic renal failure", "crf", "renal insufficiency"]),
    ("N39.0", "Urinary tract infection", ["uti", "urine infection", "cystitis"]),
    ("N20.0", "Kidney stones", ["renal calculus", "nephrolithiasis", "renal stone", "kidney stone"]),
    ("N40.0", "Benign prostatic hyperplasia", ["bph", "enlarged prostate"]),
    ("K21.9", "Gastroesophageal reflux disease", ["gerd", "gord", "acid reflux", "reflux"]),
    ("K29.70", "Gastritis", ["acid peptic disease", "apd", "stomach inflammation"]),
    ("K27.9", "Peptic ulcer", ["gastric ulcer", "duodenal ulcer", "stomach ulcer"]),
    ("K58.9", "Irritable bowel syndrome", ["ibs", "spastic colon"]),
    ("K76.0", "Fatty liver", ["hepatic steatosis", "nafld", "fatty liver disease"]),
    ("K74.60", "Cirrhosis of liver", ["liver cirrhosis", "cld", "chronic liver disease"]),
    ("K80.20", "Gallstones", ["cholelithiasis", "gall bladder stones", "gallstone"]),
    ("K35.80", "Acute appendicitis", ["appendicitis"]),
    ("R17", "Jaundice", ["icterus", "yellow discoloration"]),
    ("D50.9", "Iron deficiency anemia", ["ida", "iron deficiency anaemia", "low iron anemia"]),
    ("D64.9", "Anemia", ["anaemia", "low hemoglobin", "low haemoglobin"]),
    ("D56.9", "Thalassemia", ["thalassaemia", "thal trait", "thalassemia minor"]),
    ("D57.1", "Sickle cell disease", ["sickle cell anemia", "scd"]),
    ("G43.909", "Migraine", ["migraine headache", "hemicrania"]),
    ("G40.909", "Epilepsy", ["seizure disorder", "fits", "convulsions"]),
    ("G47.00", "Insomnia", ["sleeplessness", "sleep disorder"]),
    ("G62.9", "Peripheral neuropathy", ["neuropathy", "polyneuropathy", "nerve damage"]),
    ("F32.9", "Depressive disorder", ["depression", "major depressive disorder", "mdd"]),
    ("F41.9", "Anxiety disorder", ["anxiety", "generalized anxiety disorder", "gad"]),
    ("M19.90", "Osteoarthritis", ["oa", "degenerative joint disease", "arthritis"]),
    ("M06.9", "Rheumatoid arthritis", ["ra", "rheumatoid"]),
    ("M10.9", "Gout", ["gouty arthritis", "high uric acid arthritis"]),
    ("M81.0", "Osteoporosis", ["thin bones", "low bone density"]),
    ("M54.50", "Low back pain", ["backache", "lumbago", "back pain"]),
    ("H26.9", "Cataract", ["lens opacity"]),
    ("H40.9", "Glaucoma", ["raised intraocular pressure"]),
    ("H66.90", "Otitis media", ["middle ear infection", "ear infection"]),
    ("L30.9", "Dermatitis", ["eczema", "skin inflammation"]),
    ("L20.9", "Atopic dermatitis", ["atopic eczema"]),
    ("L40.9", "Psoriasis", ["psoriatic skin disease"]),
)

# English word, kind, spellings in script, romanised spellings.
LEXICON = (
    ("diabetes", "condition", ["شوگر", "ذیابیطس", "شوگر کی بیماری"], ["shugar", "ziabetes", "sugar ki bimari", "shugar ki bimari", "sugar ki bimaari"]),
    ("hypertension", "condition", ["بلڈ پریشر", "فشار خون", "بلند فشار خون", "ہائی بلڈ پریشر"], ["blood pressure", "high blood pressure", "balandh fishar khoon"]),
    ("asthma", "condition", ["دمہ", "سانس کی بیماری"], ["dama", "damma", "saans ki bimari"]),
    ("tuberculosis", "condition", ["ٹی بی", "تپ دق"], ["tapedik", "tibi", "ti bi", "tap e diq"]),
    ("jaundice", "condition", ["یرقان", "پیلیا"], ["yarkan", "yarqan", "pilia", "peelia"]),
    ("anemia", "condition", ["خون کی کمی"], ["khoon ki kami"]),
    ("malaria", "condition", ["ملیریا"], ["malaria"]),
    ("dengue", "condition", ["ڈینگی"], ["dengue"]),
    ("typhoid", "condition", ["ٹائیفائیڈ", "میعادی بخار"], ["typhoid"]),
    ("hepatitis", "condition", ["ہیپاٹائٹس", "کالا یرقان"], ["hepatitis", "kala yarkan"]),
    ("allergy", "condition", ["الرجی", "حساسیت"], ["allergy"]),
    ("infection", "condition", ["انفیکشن"], ["infection"]),
    ("common cold", "condition", ["زکام", "نزلہ"], ["zukam", "zukaam", "nazla", "nazla zukam"]),
    ("kidney stones", "condition", ["گردے کی پتھری"], ["pathri", "gurde ki pathri"]),
    ("heart attack", "condition", ["دل کا دورہ"], ["dil ka dora", "dil ka daura", "heart attack"]),
    ("pregnancy", "condition", ["حمل"], ["hamal"]),
    ("obesity", "condition", ["موٹاپا"], ["motapa"]),
    ("fever", "symptom", ["بخار", "تیز بخار"], ["bukhar", "bukhaar", "tez bukhar"]),
    ("cough", "symptom", ["کھانسی"], ["khansi", "khaansi", "khasi"]),
    ("pain", "symptom", ["درد", "تکلیف"], ["dard", "takleef"]),
    ("headache", "symptom", ["سر درد", "سردرد"], ["sar dard"]),
    ("abdominal pain", "symptom", ["پیٹ درد"], ["pait dard"]),
    ("chest pain", "symptom", ["سینے میں درد"], ["seene mein dard"]),
    ("shortness of breath", "symptom", ["سانس کی تکلیف"], ["saans ki takleef"]),
    ("vomiting", "symptom", ["قے", "الٹی"], ["ulti", "ultee", "qai"]),
    ("diarrhea", "symptom", ["دست", "اسہال"], ["ishaal", "dast", "pait kharab"]),
    ("constipation", "symptom", ["قبض"], ["qabz"]),
    ("dizziness", "symptom", ["چکر", "سر چکرانا"], ["chakkar", "chakar"]),
    ("weakness", "symptom", ["کمزوری", "نقاہت"], ["kamzori", "kamzoori", "nikahat"]),
    ("swelling", "symptom", ["سوجن", "ورم"], ["sojan"]),
    ("itching", "symptom", ["خارش"], ["kharish"]),
    ("sputum", "symptom", ["بلغم"], ["balgham"]),
    ("insomnia", "symptom", ["بے خوابی"], ["be khwabi"]),
    ("heart", "anatomy", ["دل", "قلب"], ["dil"]),
    ("kidney", "anatomy", ["گردہ", "گردے"], ["gurda"]),
    ("liver", "anatomy", ["جگر"], ["jigar"]),
    ("lungs", "anatomy", ["پھیپھڑے", "پھیپھڑا"], ["phephray"]),
    ("stomach", "anatomy", ["معدہ", "پیٹ"], ["mayda", "pait"]),
    ("blood", "anatomy", ["خون"], ["khoon"]),
    ("bone", "anatomy", ["ہڈی", "ہڈیاں"], ["haddi"]),
    ("joint", "anatomy", ["جوڑ", "جوڑوں"], ["joron"]),
    ("chest", "anatomy", ["سینہ", "چھاتی"], ["seena", "chaati"]),
    ("eye", "anatomy", ["آنکھ", "آنکھیں"], ["aankh"]),
    ("blood sugar", "lab", ["خون میں شکر", "شوگر ٹیسٹ"], ["shugar test"]),
    ("cholesterol", "lab", ["کولیسٹرول", "چربی"], ["cholesterol"]),
    ("thyroid", "lab", ["تھائیرائیڈ"], ["thyroid"]),
    ("weight", "lab", ["وزن"], ["wazan"]),
    ("test", "lab", ["ٹیسٹ", "معائنہ", "جانچ"], ["muaina"]),
    ("report", "lab", ["رپورٹ"], ["report"]),
    ("medicine", "medication", ["دوا", "دوائی", "ادویات"], ["dawai"]),
    ("tablet", "medication", ["گولی", "ٹیبلٹ"], ["goli"]),
    ("syrup", "medication", ["شربت"], ["sharbat"]),
    ("injection", "medication", ["ٹیکہ", "انجکشن"], ["teeka"]),
    ("dose", "medication", ["خوراک", "مقدار"], ["khurak"]),
    ("prescription", "medication", ["نسخہ"], ["nuskha"]),
    ("doctor", "general", ["ڈاکٹر", "طبیب"], []),
    ("hospital", "general", ["ہسپتال", "شفاخانہ"], ["haspatal"]),
    ("patient", "general", ["مریض"], ["mareez"]),
    ("treatment", "general", ["علاج"], ["ilaj"]),
    ("operation", "general", ["آپریشن", "جراحی"], ["operation"]),
    ("smoking", "general", ["سگریٹ", "تمباکو"], ["tambaku"]),
)


def spellings() -> dict[str, tuple[list[str], list[str]]]:
    """The lexicon by English word, as the assertion operator takes it."""
    return {english: (urdu, roman) for english, _, urdu, roman in LEXICON}


def analytes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, k) for k, r in enumerate(ANALYTES)], "key string, display string, loinc string, canonical_unit string, factors map<string,double>, synonyms array<string>, ordinal int")


def conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, k) for k, r in enumerate(CONDITIONS)], "code string, canonical string, aliases array<string>, ordinal int")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, k) for k, r in enumerate(LEXICON)], "english string, kind string, urdu array<string>, roman array<string>, ordinal int")
