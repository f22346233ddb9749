"""Word lists, phrases, patterns and texts that results are compared on.

They are data, given as they are because answers must equal them; patterns are in
Python syntax and are turned into the JVM's by ``palisade.functions.patterns``.
"""

# Words that carry no content.
STOPWORDS = (
    "the a an and or but if then this that these those is are was were be been being to of in on for with as by at from "
    "it its you your they their we our i he she his her can may might will would should could have has had do does did not no "
    "yes there here what which who when where how why about into than also more most some any all such so very just only out up "
    "okay sure yeah thanks thank hello hey please well actually really sorry great"
).split()

# Personal data, by kind, in the order of redaction.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?<!\w)(?:\+?254|0)\s?7\d{2}[\s-]?\d{3}[\s-]?\d{3}(?!\w)|(?<!\w)\+\d{1,3}[\s-]?\d{2,4}[\s-]?\d{3,4}[\s-]?\d{3,4}(?!\w)",
    "national_id": r"(?<!\d)\d{7,8}(?!\d)",
}
PII_PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "national_id": "[ID]"}

# Prompt injection, first match gives the reason; the last rule is matched line by line.
INJECTION_RULES = (
    (r"\b(ignore|disregard|forget)\b[^.]{0,40}?\b(previous|prior|above|earlier|all)\b[^.]{0,40}?\b(instructions?|prompts?|rules?|context|messages?)\b", "Instruction-override attempt detected."),
    (r"\b(you are now|from now on,? you|act as|pretend (to be|you are)|role[\s-]?play as)\b", "Role-override attempt detected."),
    (r"\b(reveal|show|print|repeat|expose|leak)\b[^.]{0,30}?\b(system|developer)?\s?(prompt|instructions?|message)\b", "Attempt to extract system prompt detected."),
    (r"\b(jailbreak|developer mode|do anything now|\bdan\b|unrestricted mode)\b", "Jailbreak attempt detected."),
    (r"\b(bypass|disable|turn off|circumvent|ignore)\b[^.]{0,30}?\b(filter|guardrail|safety|restrictions?|moderation|rules?)\b", "Attempt to bypass safety controls detected."),
    (r"(<\|?(im_start|im_end|system|assistant|user)\|?>|\[/?INST\]|###\s*(system|instruction)|^\s*system\s*:)", "Injected role/instruction markup detected."),
)

# Harmful requests.
HARMFUL_PATTERNS = (
    r"\bhow (to|do i|can i|could i)\b[^.]{0,40}?\b(make|build|create|construct|assemble)\b[^.]{0,40}?\b(bombs?|explosives?|grenades?|firearms?|guns?|weapons?|molotovs?)\b",
    r"\bhow (to|do i|can i|could i)\b[^.]{0,40}?\b(kill|murder|poison|harm|hurt|attack)\b[^.]{0,30}?\b(someone|somebody|a person|people|him|her|them|my)\b",
    r"\bhow (to|do i|can i|could i)\b[^.]{0,40}?\b(synthesi[sz]e|make|cook|produce|manufacture)\b[^.]{0,40}?\b(meth|methamphetamine|cocaine|heroin|fentanyl|ricin|sarin|nerve agents?)\b",
    r"\bhow (to|do i|can i|could i)\b[^.]{0,40}?\b(hack|break)\b[^.]{0,20}?\binto\b[^.]{0,30}?\b(account|system|network|computer|phone|email|server|database)\b",
)
HARMFUL_REASON = "Potentially harmful intent detected."
CRITICAL_REASON = "Critical emergency detected; routing to crisis handling."

CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
SPACE_RUN = r"[ \t]{2,}"

# Emergency signals, by category and tier.
SIGNALS = {
    "medical": {
        "critical": ["cardiac arrest", "heart attack", "not breathing", "stopped breathing", "can't breathe", "cannot breathe", "unconscious", "unresponsive", "overdose", "overdosed", "choking", "severe bleeding", "bleeding out", "anaphylaxis", "anaphylactic", "seizure"],
        "high": ["chest pain", "stroke", "collapsed", "severe pain", "can't move", "blood everywhere", "vomiting blood", "broken bone"],
        "low": ["dizzy", "nausea", "nauseous", "fever", "headache", "injured", "wound", "bleeding", "sick"],
    },
    "mental_health": {
        "critical": ["kill myself", "killing myself", "end my life", "ending my life", "take my own life", "want to die", "hang myself", "suicide", "suicidal"],
        "high": ["self harm", "self-harm", "hurt myself", "harm myself", "cut myself", "no reason to live", "can't go on", "don't want to live"],
        "low": ["depressed", "hopeless", "worthless", "can't cope", "overwhelmed", "give up", "empty inside"],
    },
    "physical_danger": {
        "critical": ["being attacked", "trying to kill me", "going to kill me", "he has a gun", "she has a gun", "being stabbed", "shooting"],
        "high": ["attacked", "assault", "being abused", "threatened", "in danger", "trapped", "held against"],
        "low": ["unsafe", "afraid", "scared for my"],
    },
    "crisis": {
        "critical": ["about to die", "going to die", "dying"],
        "high": ["call an ambulance", "call the police", "need help now", "this is an emergency", "life threatening"],
        "low": ["urgent", "please help", "scared", "worried"],
    },
}
NEGATIONS = ["no", "not", "never", "without", "denies", "deny", "none", "nobody"]
URGENCY = r"\b(right now|immediately|asap|hurry|urgent|emergency)\b"
CATEGORY_PRIORITY = ["medical", "mental_health", "physical_danger", "crisis"]
CONTACTS = {
    "medical": ["999", "911", "112"],
    "mental_health": ["Befrienders Kenya: +254 722 178 177", "999", "112"],
    "physical_danger": ["999", "911", "112"],
    "crisis": ["999", "911", "112", "Befrienders Kenya: +254 722 178 177"],
}
EMERGENCY_MESSAGES = {
    "medical": {
        "critical": "This may be a life-threatening medical emergency. Call emergency services immediately.",
        "high": "This may be a medical emergency. Please seek medical attention urgently or call emergency services.",
        "low": "These symptoms may need medical attention. If they worsen or feel severe, contact a medical professional or emergency services.",
    },
    "mental_health": {
        "critical": "It sounds like you may be thinking about harming yourself or ending your life. You are not alone and your life matters — please reach out to a crisis line right now.",
        "high": "It sounds like you're in severe emotional distress. Please consider reaching out to a crisis line — you don't have to face this alone.",
        "low": "It sounds like you may be struggling emotionally. If things feel overwhelming, please consider talking to someone you trust or a support line.",
    },
    "physical_danger": {
        "critical": "You may be in immediate physical danger. If you can do so safely, call emergency services right now.",
        "high": "It sounds like you may be in danger. Please contact emergency services or get to a safe place.",
        "low": "If you feel unsafe, consider contacting someone you trust or emergency services.",
    },
    "crisis": {
        "critical": "This sounds like an emergency. Please contact emergency services immediately.",
        "high": "This sounds urgent. Please contact emergency services or a support line.",
        "low": "If this is urgent, please reach out for help.",
    },
}

# Toxic answers, sensitive domains and their disclaimers.
TOXICITY_PATTERNS = (
    r"\b(you should|go|why don't you)\s+(kill yourself|end your life|harm yourself|hurt yourself)\b",
    r"\ball\s+\w+\s+(people|men|women|muslims|christians|jews|blacks|whites|asians|immigrants)\s+(are|should be)\s+(inferior|stupid|subhuman|killed|eliminated|deported)\b",
    r"\b(here'?s how to|steps to|instructions to)\b[^.]{0,40}?\b(make|build|synthesi[sz]e)\b[^.]{0,40}?\b(bomb|explosive|nerve agent|ricin|sarin|chemical weapon)\b",
    r"\b(incite|encourage|promote)\b[^.]{0,30}?\b(violence|genocide|terrorism)\b",
)
TOXICITY_REASON = "Output failed toxicity screening."
DOMAIN_PATTERNS = {
    "medical": r"\b(symptom|symptoms|diagnos\w+|treatment|medication|dosage|disease|prescription|therapy|patient|medical|drug|side effect|illness|clinical)\b",
    "legal": r"\b(lawsuit|legal|attorney|lawyer|contract|liability|court|statute|litigation|defendant|plaintiff|sue|legally)\b",
    "financial": r"\b(invest\w*|stocks?|shares?|portfolio|tax\w*|financial|returns?|dividend|interest rate|mortgage|loan|securities)\b",
}
DISCLAIMERS = {
    "medical": "Disclaimer: This information is for general educational purposes only and is not a substitute for professional medical advice. Please consult a qualified healthcare provider.",
    "legal": "Disclaimer: This information is for general informational purposes only and does not constitute legal advice. Please consult a licensed attorney for your specific situation.",
    "financial": "Disclaimer: This information is for general educational purposes only and is not financial advice. Please consult a licensed financial advisor before making decisions.",
}
DISCLAIMER_MARKER = r"\bdisclaimer\b"

# Claim separators and canned texts.
CLAIM_SEPARATORS = r"[.!?;\n]+"
REFUSAL = "I'm sorry, but I can't help with that request."
OUTPUT_REFUSAL = "I'm sorry, but I'm unable to provide a response to that."
STREAM_NOTICE = "\n\n[Notice: part of this response was withheld for safety reasons.]"
SYSTEM_PROMPT = (
    "You are a helpful, careful assistant. Answer the user's question using only the information in the provided context. "
    "If the context does not contain the answer, say you don't have enough information rather than guessing. "
    "Be concise and refer to sources by their bracket number when relevant."
)
NO_CONTEXT = "(No relevant context was retrieved.)"
