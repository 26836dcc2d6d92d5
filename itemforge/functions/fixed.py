"""Fixed values that several modules share."""

# Code points a script-style trim removes.
WS_CODES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
            0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
WS_CHARS = "".join(map(chr, WS_CODES))

# Named entities in decode order.
NAMED_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                  ("&#039;", "'"), ("&apos;", "'"))

# Metadata keys that carry a role of a document or record.
TITLE_KEYS = ("title", "name", "headline", "subject")
AUTHOR_KEYS = ("author", "authors", "by", "byline", "creator", "createdby")
DATE_KEYS = ("date", "published", "publisheddate", "publishedat", "created", "createdat", "updatedat", "timestamp")
URL_KEYS = ("url", "link", "source", "sourceurl", "canonicalurl", "permalink")
ICON_KEYS = ("icon", "iconurl", "image", "imageurl", "thumbnail", "thumbnailurl")
