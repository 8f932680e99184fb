"""Texts, labels, thresholds and tables that results must carry verbatim."""

# --- fixed values: outcome bands -------------------------------------------------------
HIGH_BAND = 0.65
LOW_BAND = 0.35
STATUS_LABEL = {1: "Elevated Risk", 0: "Low Risk", 2: "Borderline / Moderate Risk"}

# --- fixed values: longitudinal drift --------------------------------------------------
DRIFT_LIMIT = 0.08
DRIFT_STABLE = "Stable voice baseline compared to historical measurements."
DRIFT_SHIFT = (
    "WARNING: Voice characteristics have changed significantly compared to previous baseline "
    "recordings."
)

# --- fixed values: quality audit --------------------------------------------------------
QUALITY_REASONS = (
    "high background noise",
    "signal clipping",
    "insufficient speech duration/coverage",
    "out-of-distribution acoustic profile",
    "abnormal microphone response or reverb",
)
RE_RECORD = (
    "Re-recording is recommended in a quiet environment using a standard calibrated microphone."
)
QUALITY_OK = "Recording quality is verified and suitable for clinical screening."
QUALITY_WARNING = (
    "Recording quality is below the recommended threshold. Results may be less reliable."
)
QUALITY_UNREADABLE = "Unable to analyze recording quality."

# --- fixed values: authenticity warnings ------------------------------------------------
AUTH_NARROW = "Extremely compressed or low-fidelity audio channel."
AUTH_REPLAY = "Acoustic anomalies typical of speakers/room replay attacks detected."
AUTH_MONOTONE = (
    "Robotic voice pattern: Unnaturally stable pitch detected (possible TTS synth)."
)
AUTH_UNSTABLE = "Highly unstable vocal frequency: possible synthetic modulation artifact."
AUTH_SILENT = "Audio is silent or corrupted."

# --- fixed values: out-of-distribution texts --------------------------------------------
OOD_CRITICAL = (
    "Critical acoustic mismatch. Extremely high deviation from training cohort (potential "
    "non-human speech, extreme room noise, or signal corruption)."
)
OOD_MODERATE = (
    "Moderate acoustic drift detected. Voice characteristics vary from the reference group "
    "(potential microphone difference, language dialect, or speaker age/gender outlier)."
)
OOD_INSIDE = "Acoustic parameters align with reference training cohort distributions."
OOD_NOT_LOADED = "OOD detector not trained/loaded. Defaulting to in-distribution."

# --- fixed values: trust reasons ---------------------------------------------------------
TRUST_DIVERGENCE = "divergence between clinical acoustic features and neural speech patterns"
TRUST_AUTH = "audio authenticity warning flags raised"
TRUST_OOD = "speech recording differs from reference cohort distributions (OOD warning)"
TRUST_BAD_QUALITY = "CRITICAL: poor recording quality makes analysis unreliable"
TRUST_SPOOF = "CRITICAL: high probability of synthetic audio or spoofing attack"
TRUST_OUTSIDE = "CRITICAL: input falls completely outside model's training space"

# --- fixed values: fused decision, by rule in order --------------------------------------
# rule: (status, label, reasoning, recommendation); None keeps the band's status or label.
# {reasons}, {pd}, {healthy}, {cluster} are filled per row.
DECISIONS = {
    "spoofed": (
        4,
        "Assessment Suspended (Authenticity Failure)",
        "The clinical screening was aborted due to high probability of synthetic/AI-generated "
        "speech or digital replay spoofing artifacts. Authentic human voice is required.",
        "Please perform the recording live without filters, digital synthesizers, or speaker "
        "playback loopbacks.",
    ),
    "poor_quality": (
        5,
        "Assessment Suspended (Poor Quality)",
        "The recording quality is insufficient for a reliable screening analysis{reasons}. "
        "Handcrafted vocal perturbation biomarkers are highly sensitive to background noise and "
        "signal clipping.",
        "Please repeat the recording in a quiet room using a standard calibrated microphone. "
        "Ensure you hold the vowel 'ah' steadily for at least 5-10 seconds.",
    ),
    "atypical": (
        2,
        "Borderline / Atypical Profile",
        "This voice recording falls outside our standard clinical training database "
        "distribution. This may stem from a rare microphone signature, heavy background acoustic "
        "echoes, language mismatch, or extreme age/gender features. The clinical risk prediction "
        "is less reliable.",
        "The vocal profile is atypical relative to our database. A clinical consultation is "
        "advised, and you should re-record in a quiet room to rule out environment/microphone "
        "bias.",
    ),
    "inconclusive": (
        3,
        "Inconclusive Assessment",
        "Acoustic feature calculations reside in the borderline range, and the WavLM neural "
        "similarity engine reports ambiguous cohort matching (near 50%). A definitive risk "
        "classification cannot be made.",
        "The screening result is inconclusive. Please rest your vocal cords, ensure a quiet "
        "room, and repeat the screening in 24 hours.",
    ),
    "agree_high": (
        None,
        None,
        "Strong agreement observed between the clinical acoustic features (Jitter/Shimmer) and "
        "the WavLM neural similarity matching ({pd}% pathology similarity). The vocal profile "
        "exhibits patterns typical of Parkinsonian dysphonia.",
        "Consider consulting a neurologist or speech-language pathologist for a comprehensive "
        "clinical evaluation. This screening is a pre-clinical wellness aid and does not "
        "constitute a diagnosis.",
    ),
    "agree_low": (
        None,
        None,
        "Strong agreement observed between the clinical acoustic features and the WavLM neural "
        "similarity matching ({healthy}% healthy similarity). The vocal profile shows normal "
        "vocal fold control.",
        "Continue monitoring voice health. No immediate actions are required. Consider screening "
        "periodically (every 1-3 months) for wellness tracking.",
    ),
    "diverge_down": (
        2,
        "Divergent / Borderline Risk",
        "The primary classifier flags elevated risk based on clinical biomarkers "
        "(jitter/shimmer), but the WavLM embedding matches the healthy cohort closely. This "
        "divergence lowers the overall reliability.",
        "Acoustic parameters indicate mild vocal instability, but neural characteristics align "
        "with a healthy cohort. We recommend repeating the recording in 24 hours under quiet "
        "conditions.",
    ),
    "diverge_up": (
        2,
        "Divergent / Borderline Risk",
        "The primary classifier reports low risk, but the WavLM embedding indicates similarities "
        "to the Parkinsonian cohort. This conflict reduces overall diagnostic confidence.",
        "Handcrafted features indicate a stable voice, but deep neural representation matches a "
        "pathology cohort. We recommend repeating the screening in 24-48 hours under quiet "
        "conditions.",
    ),
    "standard": (
        None,
        None,
        "The voice assessment is based on a calibrated SVM classifier. The WavLM neural "
        "similarity engine provides supporting evidence in agreement ({cluster}).",
        None,
    ),
}
STANDARD_ADVICE = {
    1: "Consider consulting a medical professional for a clinical speech evaluation.",
    0: "Continue monitoring voice health. Retest periodically.",
    2: "Consider repeating the recording in a quieter room to eliminate ambient noise bias.",
}
CLUSTERS = ("Healthy Cluster", "Parkinson's Cluster")
COHORTS = ("Healthy Control", "Pathology Cohort (PD)")

# --- fixed values: second fusion, by rule in order: (confidence label, reasoning, advice) --
ALT_DECISIONS = {
    "poor_quality": (
        "Low Confidence (Poor Quality)",
        "The recording quality is insufficient for a reliable analysis. The presence of "
        "{reasons} interferes with the acoustic biomarkers.",
        "Recommend re-recording in a quiet environment. Due to poor recording quality, a "
        "reliable assessment cannot be performed.",
    ),
    "atypical": (
        "Low Confidence (Out-of-Distribution)",
        "This recording differs significantly from the reference population. The acoustic "
        "characteristics do not match the training distribution (possibly due to background "
        "noise, microphone difference, age/gender differences, or language variance). Use "
        "caution when interpreting the clinical risk score.",
        "The vocal profile is atypical relative to our reference database. A clinical "
        "consultation is advised, and you should re-record in a quiet environment to rule out "
        "ambient noise or microphone interference.",
    ),
    "inconclusive": (
        "Low Confidence (Inconclusive)",
        "Vocal biomarkers are in the borderline range and neural embedding similarity is "
        "ambiguous, leading to an inconclusive assessment. A repeat screening is recommended.",
        "The screening result is inconclusive. Please rest your vocal cords, ensure a completely "
        "quiet environment, and repeat the recording in 24 hours.",
    ),
    "agree_high": (
        "Very High Confidence",
        "There is strong congruence between the clinical acoustic biomarkers and the WavLM "
        "neural embedding similarity. The voice profile shows clear patterns associated with "
        "Parkinsonian dysphonia.",
        "Consider consulting a neurologist for a comprehensive clinical evaluation. This "
        "screening result suggests vocal patterns that warrant professional assessment. This is "
        "not a diagnosis.",
    ),
    "agree_low": (
        "Very High Confidence",
        "There is strong congruence between the clinical acoustic biomarkers and the WavLM "
        "neural embedding similarity. The voice profile shows stable vocal fold control and "
        "normal harmonic ratios.",
        "Continue monitoring voice health. No immediate action is necessary. Consider periodic "
        "screening every 1–3 months for wellness tracking.",
    ),
    "diverge_down": (
        "Moderate Confidence (Divergent Evidence)",
        "The primary classifier indicates elevated risk based on clinical biomarkers (e.g. "
        "jitter/shimmer), but WavLM embedding similarity suggests a normal voice profile. This "
        "divergence reduces overall confidence.",
        "Vocal biomarkers suggest some instability, but neural embeddings resemble a healthy "
        "profile. We recommend repeating the screening in 24 hours under quiet conditions.",
    ),
    "diverge_up": (
        "Moderate Confidence (Divergent Evidence)",
        "The primary classifier indicates low risk based on clinical biomarkers, but WavLM "
        "embedding similarity suggests patterns resembling the Parkinsonian cluster. This "
        "divergence reduces overall confidence.",
        "The primary clinical metrics are within normal ranges, but neural embedding similarity "
        "is atypical. We recommend repeating the screening in 24 hours under quiet conditions.",
    ),
    "standard": (
        None,
        "The assessment is primarily based on the Random Forest classifier trained on 48 "
        "clinical vocal biomarkers. The WavLM similarity engine provides supporting evidence "
        "({cluster}) in agreement.",
        None,
    ),
}

# --- fixed values: advice by band (also the second fusion's standard advice) ---------------
ADVICE = {
    0: "Continue monitoring voice health. No immediate action is necessary. Consider periodic "
    "screening every 1–3 months for wellness tracking.",
    2: "Consider repeating the recording in a quieter environment to rule out environmental "
    "factors. If vocal irregularities persist across multiple screenings, consult a neurologist "
    "for further evaluation.",
    1: "Consider consulting a neurologist for a comprehensive clinical evaluation. This "
    "screening result suggests vocal patterns that may warrant professional assessment. This is "
    "not a diagnosis.",
}

# --- fixed values: certainty --------------------------------------------------------------
CERTAINTY = (
    (0.70, "High Certainty", "Risk profile is highly defined"),
    (0.35, "Moderate Certainty", "Risk profile is moderately defined"),
    (None, "Low Certainty", "Borderline classification / high variance"),
)

# --- fixed values: biomarker table: key, label, unit, range, low, high, below, above, scale -
BIOMARKERS = (
    ("fo_mean", "Average Pitch (F0)", "Hz", "85–255", 85.0, 255.0, "Low", "High", 1.0),
    ("jitter_pct", "Pitch Jitter (Local)", "%", "< 1.04", None, 1.04, None, "Elevated", 1.0),
    ("shimmer_local", "Amplitude Shimmer", "%", "< 3.80", None, 3.80, None, "Elevated", 100.0),
    ("hnr", "Harmonics-to-Noise (HNR)", "dB", "> 20.0", 20.0, None, "Reduced", None, 1.0),
    ("nhr", "Noise-to-Harmonics (NHR)", "", "< 0.19", None, 0.19, None, "Elevated", 1.0),
    ("energy", "RMS Vocal Energy", "", "Variable", None, None, None, None, 1.0),
)
MFCC_ROW = ("mfcc_profile", "MFCC Profile", "—", "", "Variable", "Normal")

# --- fixed values: keyword descriptors: keywords, text when raised, text when lowered ------
DESCRIPTORS = (
    (("jitter",), "Increased Jitter", "Reduced Jitter"),
    (("shimmer",), "Elevated Shimmer", "Reduced Shimmer"),
    (("hnr", "harmonics-to-noise"), "Reduced Harmonic-to-Noise Ratio",
     "Stable Harmonic-to-Noise Ratio"),
    (("nhr", "noise-to-harmonics"), "Elevated Noise-to-Harmonics Ratio",
     "Reduced Noise-to-Harmonics Ratio"),
    (("pitch", "f0", "fo"), "Altered Pitch Characteristics", "Stable Pitch Characteristics"),
    (("energy",), "Altered Vocal Energy", "Stable Vocal Energy"),
    (("spectral",), "Altered Spectral Profile", "Normal Spectral Profile"),
    (("formant",), "Shifted Formant Frequency", "Normal Formant Frequency"),
    (("zero",), "Elevated Zero-Crossing Rate", "Normal Zero-Crossing Rate"),
)
# raised and lowered phrases of the explanation sentence
RAISED_PHRASES = (
    (("jitter",), "increased vocal jitter (pitch instability)"),
    (("shimmer",), "elevated shimmer (amplitude variation)"),
    (("hnr", "harmonics"), "altered harmonic-to-noise ratio"),
    (("nhr",), "elevated noise-to-harmonics ratio"),
    (("pitch", "f0", "fo"), "altered pitch characteristics"),
    (("energy",), "altered vocal energy patterns"),
    (("spectral",), "altered spectral characteristics"),
    (("formant",), "shifted formant frequencies"),
)
LOWERED_PHRASES = (
    (("hnr", "harmonics"), "reduced harmonicity"),
    (("jitter",), "reduced pitch jitter"),
    (("shimmer",), "reduced amplitude shimmer"),
)
EXPLAIN_CONTEXT = {
    1: "which are commonly associated with neuromotor speech characteristics found in "
    "Parkinsonian dysphonia",
    2: "which may indicate minor speech irregularities or transient vocal factors such as "
    "fatigue or environmental conditions",
    0: "however, the overall vocal profile remains within normal clinical parameters",
}
EXPLAIN_NONE_LOW = (
    "The screening analysis did not identify significant vocal biomarkers associated with "
    "neurological speech patterns. Your voice profile appears within normal parameters."
)
EXPLAIN_NONE = (
    "The screening analysis was performed but detailed biomarker attribution is currently "
    "unavailable."
)

# --- fixed values: report ------------------------------------------------------------------
REPORT_SUMMARY = {
    0: "Your voice profile shows high stability and clarity. The vocal cord vibration "
    "frequencies, amplitude changes, and signal-to-noise ratios are within normal clinical "
    "ranges. No significant voice biomarkers for Parkinson's disease were detected.",
    2: "Your voice profile shows mild irregularities. Some markers such as pitch jitter or "
    "amplitude shimmer are slightly outside standard thresholds, which can be caused by "
    "temporary factors (e.g., vocal fatigue, hoarseness, cold, dehydration) or early voice "
    "biomarkers. We recommend repeating the test under quiet conditions.",
    1: "Your voice profile demonstrates a pattern of dysphonia (vocal instability) frequently "
    "associated with neuromotor vocal impairments. Significant variations in cycle-to-cycle "
    "frequency (Jitter) and loudness (Shimmer), combined with reduced voice harmonics (HNR), "
    "indicate vocal tremor and breathiness which are common voice biomarkers of Parkinson's "
    "disease.",
}
REPORT_DRIVERS = (
    " Explainable AI (SHAP) analysis indicates that the top features contributing to this "
    "assessment are "
)
REPORT_ADVICE = {
    0: (
        "Maintain voice hygiene by staying hydrated.",
        "Repeat the voice screening periodically if you experience vocal fatigue.",
        "This report is for screening purposes; always consult a doctor if you feel unwell.",
    ),
    2: (
        "Rest your vocal cords and drink plenty of water.",
        "Ensure a completely quiet environment and repeat the test in 24 hours.",
        "Monitor for any other physical symptoms like muscle stiffness or resting tremors.",
    ),
    1: (
        "Schedule a clinical evaluation with a primary care physician or neurologist.",
        "Consult an Otolaryngologist (ENT) or Speech-Language Pathologist for a professional "
        "voice assessment.",
        "Consider tracking your vocal stability weekly to establish a clinical trend.",
    ),
}

# --- fixed values: display labels of features -----------------------------------------------
FEATURE_LABELS = {
    "MDVP:Fo(Hz)": "Average Pitch (F0)",
    "MDVP:Fhi(Hz)": "Maximum Pitch (Fhi)",
    "MDVP:Flo(Hz)": "Minimum Pitch (Flo)",
    "MDVP:Jitter(%)": "Pitch Jitter (%)",
    "MDVP:Jitter(Abs)": "Pitch Jitter (Abs)",
    "MDVP:RAP": "Pitch Jitter (RAP)",
    "MDVP:PPQ": "Pitch Jitter (PPQ)",
    "Jitter:DDP": "Pitch Jitter (DDP)",
    "MDVP:Shimmer": "Amplitude Shimmer (%)",
    "MDVP:Shimmer(dB)": "Amplitude Shimmer (dB)",
    "Shimmer:APQ3": "Amplitude Shimmer (APQ3)",
    "Shimmer:APQ5": "Amplitude Shimmer (APQ5)",
    "MDVP:APQ": "Amplitude Shimmer (APQ)",
    "Shimmer:DDA": "Amplitude Shimmer (DDA)",
    "NHR": "Noise-to-Harmonics (NHR)",
    "HNR": "Harmonics-to-Noise (HNR)",
    "Energy": "RMS Vocal Energy",
    "F1": "Formant F1 Frequency",
    "F2": "Formant F2 Frequency",
    "F3": "Formant F3 Frequency",
    "Spectral_Centroid": "Spectral Centroid",
    "Spectral_Bandwidth": "Spectral Bandwidth",
    "Zero_Crossing_Rate": "Zero-Crossing Rate",
    "RPDE": "Recurrence Period Density Entropy",
    "DFA": "Detrended Fluctuation Analysis (DFA)",
    "spread1": "Nonlinear Pitch Variation (spread1)",
    "spread2": "Nonlinear Pitch Variation (spread2)",
    "D2": "Correlation Dimension (D2)",
    "PPE": "Pitch Period Entropy (PPE)",
}

# --- fixed values: columns of the voice feature table, in file order ------------------------
VOICE_FEATURES = (
    "MDVP:Fo(Hz)", "MDVP:Fhi(Hz)", "MDVP:Flo(Hz)", "MDVP:Jitter(%)", "MDVP:Jitter(Abs)",
    "MDVP:RAP", "MDVP:PPQ", "Jitter:DDP", "MDVP:Shimmer", "MDVP:Shimmer(dB)", "Shimmer:APQ3",
    "Shimmer:APQ5", "MDVP:APQ", "Shimmer:DDA", "NHR", "HNR", "RPDE", "DFA", "spread1",
    "spread2", "D2", "PPE",
)
# features that get log1p before scaling
SKEWED_FEATURES = (
    "MDVP:Jitter(%)", "MDVP:Jitter(Abs)", "MDVP:RAP", "MDVP:PPQ", "MDVP:Shimmer",
    "MDVP:Shimmer(dB)", "Shimmer:APQ3", "Shimmer:APQ5", "MDVP:APQ", "Shimmer:DDA",
    "Jitter:DDP", "NHR",
)

# --- fixed values: admission ------------------------------------------------------------------
AUDIO_EXTENSIONS = ("wav", "mp3", "webm", "ogg")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg")
MAX_UPLOAD = 10 * 1024 * 1024
