import sys

from stepforge.cli import main

sys.exit(main())
