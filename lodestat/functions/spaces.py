"""White space as Python's ``str.strip`` sees it, as an explicit character class.

Spelled out rather than written ``(?U)\\s``: Java's Unicode classes cost a property lookup per
character, a plain class is a table test.
"""

OTHER_WHITE = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = f"[ {OTHER_WHITE}]"
WHITE_NOT_SPACE = f"[{OTHER_WHITE}]"
NOT_WHITE = f"[^ {OTHER_WHITE}]"

# The same characters, written out for functions that take a set of characters.
WHITE_CHARACTERS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
) + "\u2028\u2029\u202f\u205f\u3000"
