"""Whole texts of licenses, and the headers that files carry; fixed values.

The texts lie in ``license_texts``, one file a license, and are read where the plan is built.
"""

from __future__ import annotations

from importlib import resources

_GNU_HEADER = """This {program} is free software: you can redistribute it and/or modify
it under the terms of the GNU {name} General Public License as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version.
This {program} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU {name} General Public License for more details.
You should have received a copy of the GNU {name} General Public License
along with this {program}. If not, see <https://www.gnu.org/licenses/>."""
_GNU = [
    ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("AGPL-3.0", "Affero", "3"), ("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"),
]
_CC = [("CC-BY-4.0", "Attribution"), ("CC-BY-NC-4.0", "Attribution-NonCommercial"), ("CC-BY-SA-4.0", "Attribution-ShareAlike")]

_APACHE_HEADER = (
    """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at""",
    """Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
)

HEADERS = [
    ("Apache-2.0", "\nhttp://www.apache.org/licenses/LICENSE-2.0\n".join(_APACHE_HEADER)),
    *(("Apache-2.0", part) for part in _APACHE_HEADER),
    ("Apache-2.0", """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements. See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at"""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("MIT", "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    *(
        form
        for name, kind, version in _GNU
        for whole in [_GNU_HEADER.format(program="program", name=kind, version=version)]
        # The whole, and its first paragraph, which names the version.
        for form in [(name, whole), (name, whole.split("\nThis program is distributed")[0])]
    ),
    *((name, f"This work is licensed under a Creative Commons {kind} 4.0 International License.") for name, kind in _CC),
]
#: Licenses whose text is short enough to stand at the head of a file; its first paragraph is a form of its own.
SHORT = ("MIT", "ISC")


def forms() -> list[tuple[str, str]]:
    """All forms as (license, text)."""
    folder = resources.files(__package__) / "license_texts"
    texts = {p.name.removesuffix(".txt"): p.read_text(encoding="utf-8") for p in folder.iterdir() if p.name.endswith(".txt")}
    # The Affero license is the GNU GPL under its own name but for one section.
    texts["AGPL-3.0"] = (
        texts["GPL-3.0"].replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace("GNU General Public", "GNU Affero General Public")
        + "\nRemote Network Interaction. If you modify the Program, your modified version must prominently offer all users"
        " interacting with it remotely through a computer network an opportunity to receive the Corresponding Source."
    )
    heads = [(name, texts[name].strip().split("\n\n")[0]) for name in SHORT]
    return sorted([*texts.items(), *heads, *HEADERS])
