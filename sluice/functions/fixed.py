"""Fixed values that results depend on: patterns, word lists, categories, scores and thresholds."""

from __future__ import annotations

#: Injection patterns as (pattern, label, severity), in the order in which the first of equals wins.
INJECTION = [
    (r"(?i)ignore\s+(all\s+)?(previous|prior|above|earlier)\s+instructions?", "instruction_override", "high"),
    (r"(?i)disregard\s+(your\s+)?(previous\s+|all\s+)?instructions?", "instruction_override", "high"),
    (r"(?i)forget\s+(your\s+)?(previous\s+|all\s+)?instructions?", "instruction_override", "high"),
    (r"(?i)override\s+(your\s+)?(previous\s+|all\s+)?instructions?", "instruction_override", "high"),
    (r"(?i)you\s+(must\s+)?now\s+(ignore|disregard|forget)\s+(all\s+)?(rules|guidelines|instructions?|restrictions?|constraints?)", "instruction_override", "high"),
    (r"(?i)\bdo\s+anything\s+now\b", "jailbreak_persona", "high"),
    (r"(?i)\bDAN\s+(mode|jailbreak|prompt)\b", "jailbreak_persona", "high"),
    (r"(?i)act\s+as\s+(?:if\s+you\s+(?:are|were)\s+)?an?\s+\S+(?:\s+\S+){0,8}\s+(?:without\s+(?:restrictions?|guidelines?|rules?|ethics?)|uncensored|unfiltered)", "jailbreak_persona", "high"),
    (r"(?i)pretend\s+(?:you\s+are|to\s+be)\s+\S+(?:\s+\S+){0,8}\s+(?:AI|LLM|bot|model|assistant)\S*(?:\s+\S+){0,4}\s+(?:no\s+restrictions?|without\s+limits?|no\s+rules?)", "jailbreak_persona", "high"),
    (r"(?i)you\s+are\s+now\s+\S+(?:\s+\S+){0,8}\s+(?:unrestricted|without\s+(?:rules?|constraints?|ethics?|guidelines?)|unfiltered)", "jailbreak_persona", "high"),
    (r"(?i)let['']?s\s+(?:role.?play|pretend|imagine)\s+\S+(?:\s+\S+){0,12}\s+(?:no\s+restrictions?|without\s+(?:rules?|limits?)|can\s+say\s+anything)", "roleplay_bypass", "medium"),
    (r"(?i)in\s+this\s+(?:hypothetical|fictional|imaginary|story)\s+(?:scenario|world|universe)\S*(?:\s+\S+){0,15}\s+(?:no\s+restrictions?|without\s+limits?|unrestricted|bypass)", "roleplay_bypass", "medium"),
    (r"<\|system\|>", "token_injection", "high"),
    (r"<\|im_start\|>\s*system", "token_injection", "high"),
    (r"(?i)\[SYSTEM\][^\[]{0,500}\[END\s*SYSTEM\]", "token_injection", "high"),
    (r"(?i)###\s*SYSTEM\s*###", "token_injection", "high"),
    (r"(?i)###\s*INSTRUCTION[S]?\s*###", "token_injection", "high"),
    (r"(?i)<<SYS>>[^<]{0,500}<</SYS>>", "token_injection", "high"),
    (r"(?i)\bDAN\b[^\n]{0,80}?(?:do\s+anything|no\s+rules?|unrestricted|jailbroken|without\s+(?:rules?|limits?|restrictions?))", "jailbreak_persona", "high"),
    (r"(?i)(?:do\s+anything|no\s+rules?|unrestricted|jailbroken|without\s+(?:rules?|limits?|restrictions?))[^\n]{0,80}?\bDAN\b", "jailbreak_persona", "high"),
    (r"(?i)\b(?:you\s+are\s+now|act\s+as|pretend\s+to\s+be)\s+(?:DAN|STAN|DUDE|jailbroken|unrestricted|developer\s+mode)\b", "persona_swap", "high"),
    (r"(?i)\bwith\s+no\s+(?:rules?|restrictions?|limits?|guidelines?|filters?)\b", "jailbreak_persona", "medium"),
    (r"(?i)\b(?:sudo|developer|god|admin)\s+mode\s+(?:on|enabled?|activated?|access|now)\b", "jailbreak_persona", "high"),
    (r"(?i)\b(?:enable|activate|enter|switch\s+to)\s+(?:sudo|developer|god|admin)\s+mode\b", "jailbreak_persona", "high"),
    (r"(?i)\b(?:reveal|show|print|repeat|output|leak|expose)\s+(?:your\s+|the\s+)?(?:system\s+|hidden\s+|initial\s+|original\s+)?(?:prompt|instructions?)", "exfil_system_prompt", "high"),
    (r"(?i)\b(?:what|tell\s+me)\s+(?:are|were|is)\s+your\s+(?:original\s+|system\s+|initial\s+)?(?:instructions?|prompt|rules)", "exfil_system_prompt", "high"),
    (r"(?i)when\s+(?:the\s+)?AI\s+(?:reads?|processes?|sees?)\s+this\S*(?:\s+\S+){0,18}\s+(?:it\s+(?:must|should|will)|do|execute|run)", "indirect_injection", "high"),
    (r"(?i)if\s+you\s+(?:are|'re)\s+(?:an?\s+)?(?:AI|LLM|language\s+model)\S*(?:\s+\S+){0,12}\s+(?:follow|obey|execute|perform)", "indirect_injection", "medium"),
    (r"(?i)(jailbreak|bypass|circumvent|neutralize|disable)\s+(the\s+)?(safety|filter|guard|restrict|censor|moderat)", "safety_bypass", "high"),
    (r"(?i)(unlock|remove|disable)\s+(your\s+)?(restrictions?|safety\s+filters?|content\s+(policy|filter))", "safety_bypass", "high"),
    (r"(?i)(---+|===+|___+)\s*(new\s+instruction|system\s+prompt|ignore\s+above)", "separator_abuse", "medium"),
]
SEVERITY = {"low": 1, "medium": 2, "high": 3}

#: Keyword patterns as (pattern, category), ignoring case, dots match all; and what cancels a match.
KEYWORDS = [
    (r"\b(?:i|i\'m)\b.*\b(?:wish|want|hope)\b.*\b(?:dead|die|gone|disappear)\b", "S11"),
    (r"\b(?:wish|want|hope)\b.*\b(?:i was|i were|i\'m)\b.*\b(?:dead|gone|never born)\b", "S11"),
    (r"\b(?:better off)\b.*\b(?:dead|without me|if i (?:was|were) gone)\b", "S11"),
    (r"\b(?:world|everyone|they)\b.*\b(?:better|happier)\b.*\b(?:without me|if i (?:was|were) gone)\b", "S11"),
    (r"\b(?:nobody|no one|noone)\b.*\b(?:care|notice|miss)\b.*\b(?:if i|if i\'m|when i)\b", "S11"),
    (r"\b(?:nobody|no one|noone)\b.*\b(?:would|will)\b.*\b(?:care|notice|miss me)\b", "S11"),
    (r"\b(?:don\'?t|do not)\b.*\b(?:want|deserve)\b.*\b(?:alive|live|exist|be here|wake up)\b", "S11"),
    (r"\b(?:i|i\'m)\b.*\b(?:can\'?t|cannot)\b.*\b(?:go on|take it|do this|keep going|keep living)\b", "S11"),
    (r"\b(?:thinking|thought)\b.*\b(?:about|of)\b.*\b(?:ending it|killing myself|suicide|taking my life)\b", "S11"),
    (r"\b(?:end|ending)\b.*\b(?:my life|it all|everything)\b", "S11"),
    (r"\b(?:how (?:to|do i|can i|should i))\b.*\b(?:kill myself|end my life|commit suicide)\b", "S11"),
    (r"\b(?:i|i\'m)\b.*\b(?:cutting|burning|hurting)\b.*\b(?:myself|my (?:arm|wrist|leg|body))\b", "S11"),
    (r"\b(?:want|need|urge)\b.*\b(?:to (?:cut|burn|hurt|harm))\b.*\b(?:myself|me)\b", "S11"),
    (r"\b(?:i\'?m going to|i will|gonna)\b.*\b(?:shoot up|bomb|attack)\b.*\b(?:school|church|mosque|synagogue|temple|hospital|clinic|office|building|mall|store|concert|venue|theater|theatre|arena)\b", "S1"),
]
KEYWORD_EXCLUSIONS = [
    r"\b(?:research|study|paper|article|report|statistics|data)\b.*\b(?:suicide|self.harm)\b",
    r"\b(?:suicide|self.harm)\b.*\b(?:prevention|hotline|helpline|awareness|training|education)\b",
    r"\b(?:signs|symptoms|risk factors|warning signs)\b.*\b(?:suicide|self.harm|depression)\b",
    r"\b(?:how to help|supporting|counseling|therapy)\b.*\b(?:suicidal|depressed|self.harm)\b",
]

#: Personal-data patterns by label, in scan order.
PII = {
    "email": r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b",
    "phone_number": r"(?<!\d)(?:\+?1[\s.\-]?)?(?:\(?\d{3}\)?[\s.\-]?)\d{3}[\s.\-]?\d{4}(?!\d)",
    "ssn": r"\b\d{3}[\s.\-]?\d{2}[\s.\-]?\d{4}\b",
    "national_id": r"\b(?:\d{4}\s?\d{4}\s?\d{4}|[A-Z]{5}\d{4}[A-Z])\b",
    "date_of_birth": r"\b(?:\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\d{4}[/\-]\d{1,2}[/\-]\d{1,2})\b",
    "private_key": r"-----BEGIN\s+(?:RSA\s+|EC\s+|DSA\s+|OPENSSH\s+)?PRIVATE\s+KEY-----",
    "jwt_token": r"\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\b",
    "auth_header": r"(?iu)\b(?:Bearer|Basic|Token)\s+[A-Za-z0-9_\-\.=+/]{20,}\b",
    "aws_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "github_token": r"\b(?:ghp|gho|ghs|ghr|github_pat)_[A-Za-z0-9_]{36,255}\b",
    "slack_token": r"\bxox[bpas]\-[A-Za-z0-9\-]{10,}\b",
    "stripe_key": r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{20,}\b",
    "google_api_key": r"\bAIzaSy[A-Za-z0-9_\-]{33}\b",
    "openai_key": r"\bsk\-[A-Za-z0-9]{20,}\b",
    "twilio_sid": r"\bAC[a-f0-9]{32}\b",
    "credit_card": r"\b(?:4\d{3}|5[1-5]\d{2}|6(?:011|5\d{2})|3[47]\d{2}|3(?:0[0-5]|[68]\d)\d)[\s\-]?(?:\d[\s\-]?){8,15}\d\b",
    "iban": r"\b[A-Z]{2}\d{2}\s?[A-Z0-9]{4}[\s]?(?:[A-Z0-9]{4}[\s]?){1,7}[A-Z0-9]{1,4}\b",
    "ip_address": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "ipv6_address": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b|\b::(?:[0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}\b",
    "mac_address": r"\b(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}\b|\b(?:[0-9A-Fa-f]{4}\.){2}[0-9A-Fa-f]{4}\b",
    "database_url": r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|sqlite)://[^\s\"'<>]{10,}\b",
}
#: All labels in default scan order; those without a pattern come from a recogniser model only.
PII_LABELS = [
    "email", "phone_number", "name", "address", "ssn", "national_id", "passport_number", "date_of_birth", "driver_license",
    "password", "user_name", "private_key", "jwt_token", "auth_header", "secret",
    "api_key", "aws_key", "github_token", "slack_token", "stripe_key", "google_api_key", "openai_key", "twilio_sid",
    "credit_card", "bank_account", "iban",
    "ip_address", "ipv6_address", "mac_address", "hostname", "database_url",
]
#: Scores.
AMBIGUOUS, AMBIGUOUS_SCORE, BASE_SCORE, WEAK_SCORE = ("ssn", "date_of_birth", "phone_number", "national_id"), 0.6, 0.85, 0.5
BOOST, BEFORE, AFTER, CORROBORATION, THRESHOLD = 0.25, 100, 50, 0.05, 0.85
#: Words near a span that support its label.
CONTEXT = {
    "email": ["email", "e-mail", "contact", "reply", "from:", "to:", "cc:", "bcc:", "mailto"],
    "phone_number": ["phone", "tel", "mobile", "cell", "fax", "call", "contact", "whatsapp", "sms", "dial"],
    "ssn": ["ssn", "social security", "tax id", "taxpayer", "itin", "ein", "national id", "tin"],
    "name": ["name", "full name", "first name", "last name", "mr.", "mrs.", "ms.", "dr."],
    "address": ["address", "street", "city", "state", "zip", "postal", "suite", "apt", "residence"],
    "date_of_birth": ["born", "birthday", "dob", "date of birth", "birth date", "age", "birth"],
    "national_id": ["national id", "aadhaar", "pan", "identity", "citizen", "id number", "nric"],
    "passport_number": ["passport", "travel document", "passport number", "passport no"],
    "driver_license": ["license", "driver", "driving", "dl", "licence", "permit"],
    "password": ["password", "passwd", "pwd", "secret", "credentials", "pass", "passphrase"],
    "user_name": ["username", "user name", "login", "userid", "user id", "account", "handle"],
    "private_key": ["private key", "rsa", "ssh", "pem", "key file", "signing key"],
    "jwt_token": ["jwt", "token", "bearer", "authorization", "auth", "session"],
    "auth_header": ["authorization", "bearer", "basic auth", "token", "credentials", "header"],
    "secret": ["secret", "confidential", "sensitive", "classified", "private"],
    "api_key": ["api key", "apikey", "api_key", "key", "token", "secret", "auth"],
    "aws_key": ["aws", "amazon", "access key", "iam", "s3", "ec2", "credentials"],
    "github_token": ["github", "git", "token", "pat", "personal access", "repository"],
    "slack_token": ["slack", "bot token", "workspace", "channel"],
    "stripe_key": ["stripe", "payment", "billing", "checkout", "publishable", "secret key"],
    "google_api_key": ["google", "gcp", "api key", "maps", "youtube", "firebase"],
    "openai_key": ["openai", "gpt", "chatgpt", "api key", "model", "completion"],
    "twilio_sid": ["twilio", "sms", "sid", "account", "messaging"],
    "credit_card": ["card", "credit", "visa", "mastercard", "amex", "payment", "billing", "cvv", "expiry", "debit"],
    "bank_account": ["bank", "account", "routing", "aba", "swift", "wire", "deposit", "checking", "savings"],
    "iban": ["iban", "bank", "account", "transfer", "swift", "bic", "sepa", "international"],
    "ip_address": ["ip", "address", "host", "server", "network", "subnet", "gateway", "proxy"],
    "ipv6_address": ["ipv6", "address", "host", "server", "network"],
    "mac_address": ["mac", "hardware", "ethernet", "network interface", "nic", "physical address"],
    "hostname": ["host", "server", "domain", "fqdn", "dns", "endpoint"],
    "database_url": ["database", "db", "connection string", "dsn", "postgres", "mysql", "mongo", "redis"],
}
#: Short phrases that are never personal data, and that scope always allows.
GREETINGS = [
    "hi", "hello", "hey", "ok", "okay", "yes", "no", "thanks", "thank you", "bye", "goodbye", "sure", "please", "yo", "sup", "hola",
    "howdy", "good morning", "good evening", "good night", "good afternoon",
]

#: Invisible code points, look-alike characters, and the signs that are punctuation at a token's edge.
INVISIBLE = [0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x00AD, 0xFEFF, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x180E, 0xFFF9, 0xFFFA, 0xFFFB]
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t", "¥": "y", "€": "e", "£": "l"}
LEET_EDGE = "!@$+€£¥"

#: Safety categories and their names.
CATEGORIES = {
    "S0": "Input Validation", "S1": "Violent Crimes", "S2": "Non-Violent Crimes", "S3": "Sex-Related Crimes", "S4": "Child Sexual Exploitation",
    "S5": "Defamation", "S6": "Specialized Advice", "S7": "Privacy", "S8": "Intellectual Property", "S9": "Indiscriminate Weapons", "S10": "Hate",
    "S11": "Suicide & Self-Harm", "S12": "Sexual Content", "S13": "Elections", "S14": "Code Interpreter Abuse",
}
CATEGORY_ALIASES = {
    "violent_crimes": "S1", "non_violent_crimes": "S2", "sex_related_crimes": "S3", "sex_crimes": "S3", "child_sexual_exploitation": "S4",
    "child_exploitation": "S4", "defamation": "S5", "specialized_advice": "S6", "privacy": "S7", "intellectual_property": "S8",
    "indiscriminate_weapons": "S9", "weapons": "S9", "hate": "S10", "suicide_self_harm": "S11", "self_harm": "S11", "sexual_content": "S12",
    "elections": "S13", "code_interpreter_abuse": "S14",
}
BLOCKED = ["S1", "S3", "S4", "S9", "S11"]
INPUT_GATES = ["input", "prompt", "tool_input", "retrieval_query"]

#: Input limits.
MAX_CHARS, MAX_CHAR_REPEAT, MAX_WORD_RATIO, MIN_WORDS = 32768, 20, 0.3, 10

#: Sentence and claim patterns of grounding.
ABBREVIATIONS = r"(?i)\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|Inc|Ltd|Corp|vs|etc|approx|dept|est|govt|vol)\."
CODE_BLOCK = r"```[\s\S]*?```"
INLINE_CODE = r"^`[^`]+`$"
CODE_LINE = r"^(?:(?:import |from |def |class |if |for |while |return |print\()|(?:pip install )|(?:export )|(?:guard\s*=|result\s*=|policy\s*=)|(?:\w+\.\w+\())"
CLAIM_SKIP = [
    r"^(I |Let me |Here |Sure|Of course|Certainly)",
    r"^(However|Additionally|Furthermore|Moreover|Also|Note that)",
    r"^(If you |You can also |For more |Please |Feel free)",
    r"^(The provided context does not|I don't have|I cannot)",
    r"^(In summary|To summarize|Overall|In conclusion)",
]
CLAIM_META = [
    r"not (?:detailed|mentioned|included|provided|specified|available|found|covered|stated|listed|described) in the (?:provided |given )?context",
    r"(?:context|document|source) does not (?:contain|include|mention|provide|specify|cover|detail)",
    r"(?:Use|Apply|Try|Ensure|Make sure|Remember to) .{0,30}(?:safely|carefully|properly|appropriately|accordingly|as needed)",
    r"^(?:Use|Apply|Ensure|Remember|Make sure) (?:the |this |your )",
    r"(?:refer to|consult|check|see) (?:the )?(?:official |full )?(?:documentation|docs|guide|manual)",
]
CLAIM_FACTUAL = [
    r"\b(?:is|are|was|were|has|have|had|supports?|provides?|includes?|contains?|uses?|enables?|allows?)\b",
    r"\b(?:checks?|detects?|validates?|returns?|sends?|receives?|processes?|creates?|generates?|runs?|stores?|handles?|performs?|implements?|requires?|accepts?|rejects?|blocks?|masks?|filters?|scans?|classif(?:y|ies)|identifies?)\b",
    r"\b(?:can be|will be|should be|must be|designed to|built for|works by|known as|defined as|referred to)\b",
    r"\b\d+\b",
]

# The public conversation format of Llama Guard 3, in pieces.
PROMPT = {
    "head": "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\nTask: ",
    "input": "Check if there is unsafe content in the 'User' message according to our safety policy with the below categories.",
    "output": "Check if there is unsafe content in the 'Agent' messages according to our safety policy with the below categories.",
    "categories": "\n\n<BEGIN UNSAFE CONTENT CATEGORIES>\nLIST\n<END UNSAFE CONTENT CATEGORIES>\n\n",
    "input_begin": "<BEGIN USER MESSAGE>\nUser: ",
    "input_end": "\n<END USER MESSAGE>",
    "output_begin": "<BEGIN CONVERSATION>\nAgent: ",
    "output_end": "\n<END CONVERSATION>",
    "tail": "\n\nProvide your safety assessment for the above content:\n- First line must read 'safe' or 'unsafe'.\n- If unsafe, a second line must include a comma-separated list of violated categories.\n<|eot_id|><|start_header_id|>assistant<|end_header_id|>",
}
