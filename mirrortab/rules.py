"""Name rules behind the column classes, and the other value tables the operators look up."""

# These names decide results, so they are listed as they must match.
DIRECT_ID_NAMES = [
    "name", "patient_name", "patientname", "full_name", "fullname", "first_name", "firstname", "last_name", "lastname",
    "patient_full_name", "patient_first_name", "patient_last_name",
    "aadhaar", "aadhaar_number", "ssn", "social_security_number", "social_security", "passport_number", "passport",
    "driver_license", "drivers_license", "driver_s_license", "driving_license", "license_number",
    "national_id", "nationalid",
    "medical_record_number", "mrn", "medical_record_no", "hospital_id", "hospitalid",
    "email", "email_address", "e_mail",
    "phone", "phone_number", "mobile", "mobile_number", "telephone", "telephone_number", "fax", "fax_number",
    "address", "home_address", "street_address", "postal_address", "street", "street_name",
    "credit_card", "creditcard", "bank_account", "bankaccount", "insurance_id", "insuranceid",
    "nhs_number", "nhs", "health_id", "healthid",
    "ip_address", "ip", "mac_address", "mac",
    "photo", "photo_url", "image", "face_image",
    "latitude", "longitude", "gps",
]

# Fixed values.
LINKAGE_KEY_NAMES = [
    "patient_id", "patientid", "patient_identifier", "patientidentifier", "patient_key", "patientkey",
    "subject_id", "subjectid", "subject_key", "subjectkey",
    "participant_id", "participantid", "participant_key", "participantkey",
    "person_id", "personid", "person_key", "personkey",
    "study_id", "studyid", "study_subject_id", "encounter_subject_id", "encounter_id", "encounterid",
    "case_id", "caseid", "case_number", "cohort_id", "cohortid",
    "member_id", "memberid", "client_id", "clientid",
    "respondent_id", "respondentid", "record_id", "recordid",
]

# Fixed values.
TEMPORAL_NAMES = [
    "date", "time", "datetime", "timestamp",
    "visit_date", "visitdate", "visit_time",
    "observation_date", "observationdate", "measurement_date", "measurementdate",
    "recorded_at", "recordedat", "encounter_date", "encounterdate",
    "admission_date", "admissiondate", "discharge_date", "dischargedate",
    "event_date", "eventdate", "appointment_date", "appointmentdate",
    "test_date", "testdate", "collection_date", "collectiondate", "sample_date", "sampledate",
    "created_at", "createdat", "updated_at", "updatedat", "entry_date", "entrydate",
]

# Fixed values.
QUASI_ID_NAMES = [
    "age", "exact_age", "gender", "sex",
    "date_of_birth", "dob", "birth_date", "birthdate", "dateofbirth",
    "zip_code", "zipcode", "zip", "postal_code", "postalcode", "postcode",
    "city", "county", "region", "state",
    "precise_geolocation", "geolocation", "race", "ethnicity",
]

# Fixed values.
HEALTH_NAMES = [
    "diabetes", "diagnosis", "disease", "condition", "medical_condition", "cancer", "hypertension", "obesity", "depression",
    "blood_pressure", "systolic_bp", "diastolic_bp", "bp_systolic", "bp_diastolic",
    "bloodpressure", "systolicbp", "diastolicbp",
    "blood_pressure_systolic", "blood_pressure_diastolic", "bloodpressuresystolic", "bloodpressurediastolic",
    "heart_rate", "pulse", "temperature", "respiratory_rate",
    "glucose", "blood_glucose", "fasting_glucose",
    "bmi", "body_mass_index", "weight", "height",
    "cholesterol", "hdl", "ldl", "triglycerides", "a1c", "hba1c", "oxygen_saturation", "spo2",
    "activity_level", "activitylevel", "physical_activity", "physical_activity_minutes_week",
    "sedentary_minutes_day", "sedentary_hours", "exercise", "steps",
    "medication", "medications", "medication_adherence", "medicationadherence",
    "prescription_medication", "prescriptionmedication",
    "num_prescription_medications", "num_medications", "prescription", "prescriptions",
    "drug", "drugs", "treatment", "insulin", "dosage", "dose",
    "pain_score", "painscore", "pain", "functional_score", "disability_score",
    "lab_result", "lab_value", "test_result", "clinical_notes", "notes",
    "risk_score", "severity_score",
    "smoking", "smoking_status", "smokingstatus", "alcohol", "substance_use",
    "encounter_type", "visit_type", "payer", "insurance_type",
]

# Suffix and prefix rules applied after the exact names of the same class.
LINKAGE_KEY_PATTERN = r"_key$"
TEMPORAL_PATTERN = r"_(date|time|at)$|^(date|time)_"
DIRECT_ID_PATTERN = r"number$"

# Answer scales that make a text column ordinal.
ORDINAL_SCALES = [
    ["low", "medium", "high"],
    ["low", "moderate", "high"],
    ["never", "sometimes", "often", "always"],
    ["none", "mild", "moderate", "severe"],
    ["poor", "fair", "good", "excellent"],
    ["strongly disagree", "disagree", "neutral", "agree", "strongly agree"],
    ["1", "2", "3", "4", "5"],
]

# Rank of each answer; anything else ranks 999.
ORDINAL_RANKS = {
    "low": 0, "moderate": 1, "medium": 1, "high": 2,
    "never": 0, "sometimes": 1, "often": 2, "always": 3,
    "none": 0, "mild": 1, "severe": 2,
    "poor": 0, "fair": 1, "good": 2, "excellent": 3,
    "strongly disagree": 0, "disagree": 1, "neutral": 2, "agree": 3, "strongly agree": 4,
}
ORDINAL_UNKNOWN_RANK = 999

# Spellings of yes and no.
TRUE_WORDS = ["true", "yes", "1"]
FALSE_WORDS = ["false", "no", "0"]

# Spellings that a CSV reader treats as missing.
MISSING_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                 "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Date spellings that are recognised, as (shape, Spark pattern).
DATE_SHAPES = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
]
