"""Word lists and tables that results depend on."""

# English stop words.
STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by
can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't
have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is
isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves
out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves
then there there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd
we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't would
wouldn't you you'd you'll you're you've your yours yourself yourselves will shall may might must page
""".split()

# The lists of retrieval and of summaries hold the same words.
QA_STOP_WORDS = SUMMARY_STOP_WORDS = STOP_WORDS

# Stop words of tags and classes.
TAG_STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by
can can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't
have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is
isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves
out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves
then there there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd
we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't would
wouldn't you you'd you'll you're you've your yours yourself yourselves page document total number date details please thank
thanks regards sincerely www com org http https email phone tel fax null undefined pdf scanned scan copy file item items
""".split()

# Syllables of irregular words.
SYLLABLES = {
    "queue": 1, "rhythm": 2, "rhythms": 2, "subtle": 2, "simile": 3, "recipe": 3, "create": 2, "created": 2, "creates": 2,
    "creative": 3, "creation": 3, "area": 3, "areas": 3, "idea": 3, "ideas": 3, "poem": 2, "poems": 2, "poetry": 3, "lion": 2,
    "lions": 2, "science": 2, "society": 4, "quiet": 2, "quietly": 3, "video": 3, "videos": 3, "radio": 3, "media": 3,
    "naive": 2, "oasis": 3, "syllable": 3, "syllables": 3, "business": 2, "people": 2, "separate": 3, "interesting": 4,
    "comfortable": 4, "temperature": 4,
}

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = r"Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|e\.g|i\.e|Ltd|Inc|Corp|No|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"

#: ASCII word boundaries, which Java's \b is not: before a word, behind one, and either.
B, E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
EDGE = f"(?:(?<=[A-Za-z0-9_]){E}|{B}(?=[A-Za-z0-9_]))"
