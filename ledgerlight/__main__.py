"""python -m ledgerlight serve --root FOLDER"""

from ledgerlight.service.http import main

main()
