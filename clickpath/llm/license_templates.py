"""Licence templates: short grants made from names by rule, notices and the permission texts of short licences, and
distinctive passages of the long ones. ``MUST`` has what a match of a template must hold word for word."""

# SPDX identifiers and the names that grants use.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "MIT": ["MIT License", "MIT"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL version 3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "Unlicense": ["Unlicense"],
}

GRANTS = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}",
          "Distributed under the {}", "Available under the {}", "Published under the {}",
          "This work is licensed under {}", "This work is licensed under the {}",
          "This software is licensed under the {}", "This file is licensed under the {}"]

# Permission texts of licences, public.
TEXTS = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met:"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"],
    "GPL-2.0": ["By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free "
                "software--to make sure the software is free for all its users.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."],
    "LGPL-2.1": ["This license, the Lesser General Public License, applies to some specially designated software packages--typically "
                 "libraries--of the Free Software Foundation and other authors who decide to use it.",
                 "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
                 "option) any later version."],
    "LGPL-3.0": ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU "
                 "General Public License, supplemented by the additional permissions listed below.",
                 "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                 "option) any later version."],
    "AGPL-3.0": ["The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically "
                 "designed to ensure cooperation with the community in the case of network server software.",
                 "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                 "option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "\"Covered Software\" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the "
                "Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including "
                "portions thereof."],
    "EPL-2.0": ["Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE"],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
                "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
                "execute, and transmit the Software, and to prepare derivative works of the Software"],
    "CC0-1.0": ["Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of "
                "Affirmer's Copyright and Related Rights"],
    "GPL-3.0": ["The GNU General Public License is a free, copyleft license for software and other kinds of works.",
                "the GNU General Public License is intended to guarantee your freedom to share and change all versions of a "
                "program--to make sure it remains free software for all its users.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission."],
}

# The licence text of each Creative Commons licence names it in its first sentence.
_CC = ("By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this "
       "{} Public License")
TEXTS.update({name: [_CC.format(n.removesuffix(" License")) for n in names if n.startswith("Creative Commons")]
              for name, names in NAMES.items() if name.startswith("CC-")})

TEMPLATES = {name: [g.format(n) for n in names for g in GRANTS] + TEXTS.get(name, []) for name, names in NAMES.items()}
TEMPLATES["proprietary"] = TEXTS["proprietary"]

#: Phrases of a template that a match must hold: a grant's name (with the word before it, if it is one word) and
#: what tells the texts of one family apart.
MUST = {g.format(n): [n if len(n.split()) > 1 else f"{g.split()[-2]} {n}"] for names in NAMES.values() for n in names for g in GRANTS}
MUST.update({_CC.format(n.removesuffix(" License")): [f"{n.removesuffix(' License')} Public License"]
             for names in NAMES.values() for n in names if n.startswith("Creative Commons")})
_TELLS = {"GPL-2.0": [["change free", "software is free"], ["GNU General", "version 2 of"]],
          "LGPL-2.1": [["Lesser General"], ["Lesser General", "version 2.1"]],
          "LGPL-3.0": [["Lesser General", "version 3"], ["Lesser General", "version 3"]],
          "AGPL-3.0": [["Affero General"], ["Affero General", "version 3"]],
          "GPL-3.0": [["GNU General"], ["all versions", "it remains"], ["GNU General", "version 3"]],
          "MPL-2.0": [["Mozilla Public", "v. 2.0"], []], "EPL-2.0": [["Eclipse Public License - v 2.0"]],
          "Apache-2.0": [["Apache License, Version 2.0"]]}
MUST.update({text: must for name, all_ in _TELLS.items() for text, must in zip(TEXTS[name], all_)})
