import sys

from .project import main

sys.exit(main())
