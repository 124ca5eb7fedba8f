"""Text rules for tags, user names and e-mail addresses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a trim removes from a tag ...
TRIMMED = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# ... what a user name may hold ...
USERNAME_PATTERN = r"^[a-zA-Z0-9_]+\z"
USERNAME_LENGTH = (3, 255)
# ... and the shape of an e-mail address. (\z because $ would let a final line break pass.)
EMAIL_PATTERN = r"(?i)^(?!\.)(?!.*\.\.)([A-Z0-9_'+\-\.]*)[A-Z0-9_+-]@([A-Z0-9][A-Z0-9\-]*\.)+[A-Z]{2,}\z"


def same_tag(tag: Column | str) -> Column:
    """Two tags are the same one when this form of them is equal."""
    return F.lower(F.btrim(tag, F.lit(TRIMMED)))


def is_username(text: Column) -> Column:
    shortest, longest = USERNAME_LENGTH
    return F.length(text).between(shortest, longest) & text.rlike(USERNAME_PATTERN)


def is_email(text: Column) -> Column:
    return text.rlike(EMAIL_PATTERN)


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""
