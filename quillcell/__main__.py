import sys

from quillcell.cli import main

sys.exit(main())
