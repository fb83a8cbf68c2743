"""Fixed values. The rules only give the published results with exactly these."""

# Labels a model answer may carry, in list order.
SENIORITY_LABELS = [
    "experienced", "intermediate", "senior", "entry level", "assistant", "lead", "head",
    "junior", "graduate", "trainee", "associate", "principal", "apprentice", "executive",
    "manager", "director", "entry-level", "chief", "deputy", "mid-level", "specialist",
    "experienced assistant", "supervisor", "qualified", "student", "board",
    "graduate/junior", "senior associate", "mid-senior",
]

# Labels the word-vector vote chooses from, in list order.
VOTE_LABELS = [
    "apprentice", "experienced", "intermediate", "senior", "director", "deputy", "chief",
    "doctoral", "assistant", "associate", "principal", "executive", "graduate",
    "entry level", "junior", "qualified",
]

CURRENCIES = ["AUD", "SGD", "HKD", "IDR", "THB", "NZD", "MYR", "PHP", "USD", "None"]
FREQUENCIES = ["HOURLY", "DAILY", "WEEKLY", "MONTHLY", "ANNUAL", "None"]
NO_SALARY = "0-0-None-None"

NATION_CURRENCY = {
    "AUS": "AUD", "SG": "SGD", "HK": "HKD", "ID": "IDR",
    "TH": "THB", "NZ": "NZD", "MY": "MYR", "PH": "PHP",
}

# The first frequency with any of its keywords wins, so the order matters.
FREQUENCY_KEYWORDS = {
    "WEEKLY": ["per week"],
    "ANNUAL": ["per year", "per annum", "p.a.", "yearly", "annually"],
    "HOURLY": ["per hour", "p.h.", "ph", "p/hr", "hourly", "hr"],
    "DAILY": ["per day"],
    "MONTHLY": ["per month", "p.m.", "monthly"],
}

# Patterns of whole words and phrases.
REMOTE_PHRASES = ["remote", "work from home", "wfh", "telecommut(e|ing)", "virtual"]
ONSITE_PHRASES = ["in person", "on[ -]?site", "at our offices?", "on campus"]
HYBRID_PHRASES = ["hybrid", "flexible", "mixed[- ]mode"]

# Pictographs, in the four blocks that titles are cleaned of.
EMOJI_RANGES = r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"

TASK_MARKERS = {
    "Salary": "[TASK: Salary]",
    "Seniority": "[TASK: Seniority]",
    "Work Arrangement": "[TASK: Work Arrangement]",
}

# Prompt texts. Models were trained and asked with these words, so they are data.
TAGGED_PREFIX = {
    "salary": "[TASK: Salary] Extract salary information from the job ad. \n\n",
    "seniority": "[TASK: Seniority] Extract seniority level from the job ad. \n\n",
    "arrangement": "[TASK: Work Arrangement] Extract work arrangement from the job ad. \n\n",
}
ZERO_SHOT_PREFIX = {
    "salary": """\
You are an information extraction assistant.
Your task is to extract salary information from a job advertisement.
STRICTLY follow the format: [min]-[max]-[currency]-[unit]
Example: 32-45-AUD-HOURLY
Do NOT add explanations, comments, or extra text.
Do NOT include anything else.
If no salary is found, return exactly: 0-0-None-None
Return the result ONLY.

""",
    "seniority": """\
You are a seniority classification assistant.
Extract the most suitable seniority level from the job ad.
Choose ONE from the following: trainee, entry level, intermediate, experienced, senior, lead
Output must be a SINGLE WORD from the list.
Do NOT explain your reasoning.
Do NOT return full sentences, just the one word.

""",
    "arrangement": """\
You are a job arrangement classifier.
Classify the work arrangement of the job ad.
Output must be ONLY ONE word from: OnSite, Remote, Hybrid
Do NOT explain.
Do NOT include labels or additional words.
The output must be EXACTLY one of the three options, nothing else.

""",
}
EXPERT_TEMPLATE = {
    "Salary": """\
You are an expert at extracting salary information from job postings.

    Extract salary information from the job ad.
        
    Output format: [min]-[max]-[currency]-[time_unit]
    
    Valid currencies: AUD, SGD, HKD, IDR, THB, NZD, MYR, PHP, USD, None
    Valid time units: HOURLY, DAILY, WEEKLY, MONTHLY, ANNUAL, None
        
    Input: {prompt}
    
    Output:""",
    "Seniority": """\
You are an expert at identifying seniority levels in job postings.
    
    Extract seniority level from the job ad.
       
    Valid seniority options: experienced, intermediate, senior, entry level, assistant, lead, head, junior, graduate, trainee, associate, principal, apprentice, executive, manager, director, entry-level, chief, deputy, mid-level, specialist, experienced assistant, supervisor, qualified, student, board, graduate/junior, senior associate, mid-senior
    
    Choose the most appropriate option from the valid seniority list above.
    
    Input: {prompt}
    
    Output:""",
    "Work Arrangement": """\
You are an expert at identifying work arrangements in job postings.

    Analyze the job posting and determine the work arrangement:
    - OnSite: Must work from office/specific location, no remote work mentioned
    - Remote: Can work from home/anywhere, mentions remote work, telecommute, work from home, distributed team, etc.
    - Hybrid: Combination of office and remote work, flexible arrangements, some days in office
    
    Look for these indicators:
    Remote: "remote", "work from home", "WFH", "telecommute", "distributed", "anywhere", "home-based"
    Hybrid: "hybrid", "flexible", "mix of remote and office", "some days in office", "2-3 days in office"
    OnSite: "on-site", "in-office", "office-based", no remote work mentioned
    
    Output only: OnSite, Remote, or Hybrid
    
    Input: {prompt}
    
    Output:""",
}

# Header lines of a structured ad, in the order they are written back.
HEADER_FIELDS = ["Job Title", "Abstract", "Employer", "Location", "Highlights"]

# Tag vocabularies; the id of a tag is its position.
POS_TAGS = ["PAD", "ADJ", "NOUN", "VERB", "ADV", "PRON", "DET", "ADP", "PROPN", "PUNCT"]
ENTITY_TAGS = ["PAD", "PERSON", "ORG", "GPE", "LOC", "PRODUCT", "DATE", "O"]
LEADING_TAG_PADS = 20

# Sizes of encoded examples.
IGNORED = -100
EXAMPLE_LENGTH = 512
TAG_IDS_LENGTH = 1024
WINDOW_LENGTH = 1024
TAIL_LENGTH = 128
HEAD_LENGTH = 896
STRIDE = 896
SHORTEST_CHUNK = 128
ARRANGEMENT_CLASSES = ["Onsite", "Remote", "Hybrid"]

# Checked answering.
MAX_TRIES = 5
CALL_TRIES = 3
BATCH_SIZE = 8

# Patterns and the marker by which answers are read.
ANSWER_SALARY = r"(\d+-\d+-[A-Z]+-[A-Z]+|0-0-None-None)"
REPORTED_SALARY = r"\d{3,6}-\d{3,6}-[A-Z]{3,4}-[A-Z]+"
OUTPUT_MARKER = "Output:"

# Patterns of numbers in ads.
INTEGER = r"\d[\d,]*"
AMOUNT = r"\$?(\d{1,7}(?:,\d{3})*(?:\.\d+)?%?)"

# Who speaks in a chat: marker in the first message and agent in order of the tests, mentions, and
# what a planner says.
AGENT_MARKERS = [
    ("[TASK: Work Arrangement]", "Arrangement"),
    ("[TASK: Salary]", "Salary"),
    ("[TASK: Seniority]", "Seniority"),
]
MENTIONS = [("@Salary", "Salary"), ("@Seniority", "Seniority"), ("@Arrangement", "Arrangement")]
PLANS = [("SALARY", "Salary"), ("SENIORITY", "Seniority"), ("ARRANGEMENT", "Arrangement")]
AGENTS = ["Salary", "Seniority", "Arrangement"]
