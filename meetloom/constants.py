"""Fixed values of the schedule format."""

# Days, time blocks (index, start, end), breaks.
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")
TIME_BLOCKS = ((0, "08:30", "10:30"), (1, "11:00", "13:00"), (2, "14:30", "16:30"), (3, "17:00", "19:30"))
BREAKS = (("10:30", "11:00"), ("13:00", "14:30"), ("16:30", "17:00"))

# Folders without schedules, file extensions in order of preference, error phrases.
BLACKLISTED_FOLDERS = ("Agenda", "drafts", "Tdoc_list", "Welcome_speech")
DOCUMENT_EXTENSIONS = (".docx", ".pptx", ".pdf")
ERROR_PHRASES = ("our services aren't available right now", "we're working to restore all services", "service unavailable")
ERROR_PAGE_BYTES = 4096

# The layout grid.
DAY_START = 8 * 60 + 30
DAY_END = 19 * 60 + 45
ROW_MINUTES = 5
PALETTE_SIZE = 16
COLOR_TOLERANCE = 8
