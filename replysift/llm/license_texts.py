"""Whole texts of common licences, as their publishers word them (``license_texts.txt`` beside this
module: a line ``=== <id>``, then the text). Read on the driver only."""

import pkgutil


def _texts() -> list[tuple[str, str]]:
    data = pkgutil.get_data(__package__, "license_texts.txt").decode()
    out = []
    for section in ("\n" + data).split("\n=== ")[1:]:
        name, _, text = section.partition("\n")
        out.append((name, text))
    out[-1] = (out[-1][0], out[-1][1].removesuffix("\n"))  # each text ends before the line break that the format adds
    return out


#: BSD-3-Clause; the variants of the BSD licences are made of it.
BSD_3 = _texts()[0][1]
TEXTS = tuple(_texts()[1:])
